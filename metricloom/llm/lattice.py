"""Distinct sampled segmentations of whole texts into sentence pieces, and the way back."""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import pack, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
#: Texts are sampled together up to so many units, and longer ones in slices of as many.
UNITS = 200_000
#: A worker forgets its compiled units beyond this number of characters.
KNOWN = 2_000_000
#: So many units are compiled at once; their arrays fit a processor's caches.
TOGETHER = 8192
SPACE = "▁"
# How far a piece's rank bends the Zipf law of its probability.
BEND = 10.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers in place (the finaliser of splitmix64)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _codes(text: str) -> np.ndarray:
    """Code points; spaces as ``SPACE``, a ``SPACE`` of the text as a number no piece has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    own = codes == ord(SPACE)
    codes[codes == 32] = ord(SPACE)
    codes[own] = 0xFFFFFFFF
    return codes


def _line(text: str) -> bytes:
    """The text with the model's leading space, which an empty text has not."""
    return (" " + text).encode("utf-8", "surrogatepass") if text else b""


def _split(lines: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The units of all lines in order, and the number of units before each line's end.

    A unit is a line feed, a word with the spaces before it, or spaces with no word behind.
    """
    data = b"".join(lines)
    flat = np.frombuffer(data, dtype=np.uint8)
    ends = np.cumsum([len(line) for line in lines], dtype=np.int64)
    feed, space = flat == 10, flat == 32
    head = feed.copy()
    head[1:] |= feed[:-1]
    head[1:] |= space[1:] > space[:-1]
    head[np.append(0, ends[:-1])[: len(lines)][np.diff(ends, prepend=0) > 0]] = True
    offsets = np.append(np.flatnonzero(head), len(flat))
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return units, np.searchsorted(offsets[:-1], ends)


class Pieces:
    """Vocabulary and log-probabilities of a model's pieces.

    The model ranks its pieces and gives no probabilities, so a piece's probability is
    that of a Zipf law over its rank. Bytes spell characters that have no piece.
    """

    def __init__(self, model: bytes, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        raw = [p.replace(SPACE, " ").encode() for p in self.names]
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())
        self.byte_of = np.array([self.byte_ids[b] for b in range(256)], dtype=np.int32)
        plain = [
            i
            for i in range(len(self.names))
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        ]
        weight = 1 / (np.arange(len(plain)) + BEND)
        total = weight.sum() + 256 / (len(plain) + BEND)
        self.logp = np.zeros(len(self.names))
        self.logp[plain] = alpha * np.log(weight / total)
        self.byte_logp = alpha * float(-np.log((len(plain) + BEND) * total))
        self.longest = max(len(self.names[i]) for i in plain)
        # Beginnings of pieces by hash; one step hashes a place of all pieces that have it.
        length = np.array([len(self.names[i]) for i in plain])
        by_length = np.argsort(-length, kind="stable")
        ids, length = np.array(plain)[by_length], length[by_length]
        codes = _codes("".join(self.names[i] for i in ids).replace(SPACE, " "))
        begin = np.cumsum(length) - length
        hashes, met = np.zeros(len(ids), dtype=np.uint64), []
        for n in range(self.longest):
            live = int(np.searchsorted(-length, -n, "left"))  # pieces longer than n
            hashes[:live] = self.roll(hashes[:live], codes[begin[:live] + n])
            met.append(hashes[:live].copy())
        self.hashes = np.unique(np.concatenate(met))
        # The piece that a beginning is, -1 for none; the last one is that of no beginning.
        self.piece = np.full(len(self.hashes) + 1, -1, dtype=np.int32)
        self.piece[np.searchsorted(self.hashes, hashes)] = ids
        # Open addressing: a beginning lies in the first free place from its own.
        self.slots = np.full(1 << _SLOTS, -1, dtype=np.int32)
        open_ = np.arange(len(self.hashes), dtype=np.int32)
        at = self.slot(self.hashes)
        while len(open_):
            free = self.slots[at] < 0
            self.slots[at[free]] = open_[free]
            left = self.slots[at] != open_
            open_, at = open_[left], (at[left] + 1) % len(self.slots)

    @staticmethod
    def roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of strings that are longer by one code point."""
        return _mix((h + np.uint64(1)) * _MULTIPLIER + codes.astype(np.uint64))

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The beginning of pieces that has each hash, -1 for none."""
        at = self.slot(h)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.hashes[found[wrong]] != h[wrong])]
        return found

    def units(self, text: str) -> pa.LargeBinaryArray:
        """Parts that no piece crosses, in order; the text gets the model's leading space."""
        return _split([_line(text)])[0]

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, end to end, and the place of each one's first and of the end."""
        if not len(ids):
            return b"", np.zeros(1, dtype=np.int64)
        found = self.raw.take(pa.array(ids, pa.int32()))
        _, offsets, data = found.buffers()
        return data.to_pybytes(), np.frombuffer(offsets, dtype=np.int64)[: len(found) + 1]

    def decode(self, ids) -> str:
        """The text of the ids, without the model's leading space."""
        data, offsets = self.spell(ids)
        return data[: offsets[-1]].decode("utf-8", "surrogatepass")[1:]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1024, dtype=dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            room = max(2 * len(self.data), self.size + len(more))
            grown = np.empty(room, self.data.dtype)  # room that is not used yet takes no memory
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)


class Compiled:
    """The lattices of all units met so far, laid end to end.

    A state is a place in a unit, an edge a piece from there: its probability among the
    state's edges, weighed by all ways to go on behind it. So choosing edge after edge draws
    a whole segmentation from the distribution over all of them. A state's edges lie side by
    side; its number is that of the first, and ``upto`` of the last is 2.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.chars = 0
        # Of units: state of the first character; characters and edges before all added with them.
        self._start = _Grown(np.int32)
        self._chars_before, self._edges_before = _Grown(np.int64), _Grown(np.int64)
        self._logp, self._upto = _Grown(np.float64), _Grown(np.float64)  # of edges
        self._to, self._id = _Grown(np.int32), _Grown(np.int32)
        self._views()

    def forget(self) -> None:
        """Back to the units met first, among which are the frequent ones."""
        before = self._chars_before.data[: self._chars_before.size]
        kept = int(np.searchsorted(before, KNOWN // 2))
        if kept == self._start.size:
            return self.clear()
        self.number = dict(itertools.islice(self.number.items(), kept))
        self.chars, edges = int(before[kept]), int(self._edges_before.data[kept])
        self._start.size = self._chars_before.size = self._edges_before.size = kept
        self._logp.size = self._upto.size = self._to.size = self._id.size = edges

    def _views(self) -> None:
        for name in ("start", "logp", "upto", "to", "id"):
            setattr(self, name, getattr(self, f"_{name}").data)

    def look_up(self, units: pa.LargeBinaryArray) -> np.ndarray:
        coded = units.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int64)[: len(coded.dictionary) + 1].tolist()
        data = data.to_pybytes() if data else b""
        names = [data[x:y] for x, y in itertools.pairwise(cuts)]
        found = map(self.number.get, names, itertools.repeat(-1))
        own = np.fromiter(found, dtype=np.int64, count=len(names))
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = np.arange(len(self.number), len(self.number) + len(new))
            for a in range(0, len(new), TOGETHER):
                self._add([names[i] for i in new[a : a + TOGETHER].tolist()])
        return own.take(coded.indices.to_numpy())

    def _add(self, units: list[bytes]) -> None:
        pieces = self.pieces
        known = len(self.number)
        self.number.update(zip(units, range(known, known + len(units)), strict=True))
        data = b"".join(units)
        codes = _codes(data.decode("utf-8", "surrogatepass"))
        # Characters of each unit: its bytes that do not continue one.
        size = np.cumsum([len(u) for u in units], dtype=np.int64)
        begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        size = np.diff(np.cumsum(begins)[size - 1], prepend=0)
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(codes))  # characters to the unit's end
        # Every substring of a unit that is a piece; the longest first.
        at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        places, lengths, ids = [], [], []
        for n in range(1, pieces.longest + 1):
            h = pieces.roll(h, codes.take(at + n - 1))
            begun = pieces.find(h)
            found = pieces.piece.take(begun, mode="wrap")
            if n == 1:
                # A character without a piece is spelled in bytes: -2 and its code point.
                spelt = np.where(codes == 0xFFFFFFFF, ord(SPACE), codes).astype(np.int64)
                found = np.where(found >= 0, found, -2 - spelt)
                hit = at
            else:
                hit = np.flatnonzero(found >= 0)
            places.append(at[hit])
            lengths.append(np.full(len(hit), n))
            ids.append(found[hit])
            # Only what a piece begins with can become one.
            live = np.flatnonzero((begun >= 0) & (left.take(at) > n))
            if not len(live):
                break
            at, h = at.take(live), h.take(live)
        # States in the order of their distance from the end, so that those behind come first.
        far = int(left.max(initial=0))
        order = np.argsort(left.astype(np.uint16) if far < 2**16 else left, kind="stable")
        state = np.empty(len(codes), dtype=np.int64)
        state[order] = np.arange(len(codes))
        # Edges by state, each state's longest first; a place has one edge of a length at most.
        rank, count = [], np.zeros(len(codes), dtype=np.int64)
        for at in places[::-1]:
            rank.append(count[at])
            count[at] += 1
        count = count[order]
        first = np.cumsum(count) - count
        place = np.concatenate(places[::-1])
        edges = first[state[place]] + np.concatenate(rank)
        own, length, id_ = (np.empty(len(edges), dtype=np.int64) for _ in range(3))
        own[edges] = state[place]
        length[edges], id_[edges] = np.concatenate(lengths[::-1]), np.concatenate(ids[::-1])
        behind = order[own] + length
        last = length == left[order[own]]
        to = np.where(last, -1, state[np.minimum(behind, len(codes) - 1)])
        spelled = id_ < 0
        logp = pieces.logp[np.maximum(id_, 0)]
        if spelled.any():
            c = -2 - id_[spelled]
            logp[spelled] = pieces.byte_logp * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        beta = np.zeros(len(codes) + 1)  # the last is a unit's end, which -1 points at
        steps = np.append(np.flatnonzero(np.diff(left[order], prepend=0)), len(codes))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            x, y = first[a], first[b] if b < len(codes) else len(own)
            s = logp[x:y] + beta[to[x:y]]
            heads, who = first[a:b] - x, own[x:y] - a
            top = np.maximum.reduceat(s, heads)
            total = top + np.log(np.add.reduceat(np.exp(s - top[who]), heads))
            beta[a:b] = total
            logp[x:y] = s - total[who]
        upto = np.cumsum(np.exp(logp))
        upto -= np.repeat(upto[first] - np.exp(logp[first]), count)
        upto[first + count - 1] = 2.0
        edges0 = self._logp.size
        self._start.add(edges0 + first[state[ends - size]])
        self._chars_before.add(np.full(len(units), self.chars))
        self._edges_before.add(np.full(len(units), edges0))
        self.chars += len(codes)
        self._logp.add(logp)
        self._upto.add(upto)
        self._to.add(np.where(to < 0, -1, edges0 + first.take(to, mode="wrap")))
        self._id.add(id_)
        self._views()

    def ids_of(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each path of edges."""
        ids = self.id.take(np.concatenate(paths))
        ends = np.cumsum([len(p) for p in paths])
        spelled = np.flatnonzero(ids < 0)
        if not len(spelled):
            return np.split(ids, ends[:-1])
        codes = -2 - ids[spelled].astype(np.int64)
        out, at = ids, spelled
        if codes.max() > 0x7F:
            size = np.ones(len(ids), dtype=np.int64)
            size[spelled] += (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            out = np.repeat(ids, size)
            behind = np.cumsum(size)
            at = (behind - size)[spelled]
            ends = np.append(0, behind)[ends]
        out[at] = self.pieces.byte_of[np.minimum(codes, 255)]
        for i, c in zip(at[codes > 0x7F].tolist(), codes[codes > 0x7F].tolist(), strict=True):
            raw = chr(c).encode("utf-8", "surrogatepass")
            out[i : i + len(raw)] = [self.pieces.byte_ids[b] for b in raw]
        return np.split(out, ends[:-1])


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can: a worker that waits for its
    next task holds no more than its compiled units."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 of 64-bit keys; changes the keys."""
    u = (_mix(keys) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _follow(table: Compiled, jobs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Draw each job's (units, seed, first unit, its state or -1) way to the end of its text:
    (unit, edge) of each step."""
    found = [[] for _ in jobs]
    batch, held = [], 0
    pieces = []
    for i, (units, _, unit, _) in enumerate(jobs):
        for a in range(unit, len(units), UNITS):
            b = min(len(units), a + UNITS)
            if batch and held + b - a > UNITS:
                pieces.append(batch)
                batch, held = [], 0
            batch.append((i, a, b))
            held += b - a
    for batch in [*pieces, batch]:
        if batch:
            _draw(table, jobs, batch, found)
    empty = np.zeros(0, dtype=np.int32)
    whole = []
    for f in found:
        if len(f) > 1:
            f = [(np.concatenate([u for u, _ in f]), np.concatenate([e for _, e in f]))]
        whole.append(f[0] if f else (empty, empty))
    return whole


def _draw(table: Compiled, jobs: list[tuple], batch: list[tuple], found: list[list]) -> None:
    size = [b - a for _, a, b in batch]
    types = np.concatenate([jobs[i][0][a:b] for i, a, b in batch])
    unit = np.concatenate([np.arange(a, b, dtype=np.int32) for _, a, b in batch])
    seed = np.repeat(np.array([jobs[i][1] for i, _, _ in batch], dtype=np.uint64), size)
    now = table.start.take(types).astype(np.int64)
    begin = 0
    for (i, a, _), n in zip(batch, size, strict=True):
        if jobs[i][3] >= 0 and a == jobs[i][2]:
            now[begin] = jobs[i][3]
        begin += n
    seed += _mix((unit.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER)
    active = np.arange(len(now))
    step, places, edges = 0, [], []
    taken = np.zeros(len(now), dtype=np.int64)
    while len(active):
        u = _uniform(seed + np.uint64(step * int(_MULTIPLIER) % 2**64))
        edge = now
        beyond = np.flatnonzero(u >= table.upto.take(edge))
        if len(beyond):
            at, u = edge.take(beyond), u.take(beyond)
            while len(beyond):
                at += 1
                more = u >= table.upto.take(at)
                edge[beyond] = at
                beyond, at, u = beyond[more], at[more], u[more]
        places.append(active)
        edges.append(edge)
        step += 1
        now = table.to.take(edge)
        ended = now < 0
        taken[active[ended]] = step
        live = np.flatnonzero(~ended)
        active, now, seed = active.take(live), now.take(live).astype(np.int64), seed.take(live)
    ends = np.cumsum(taken)
    begin = ends - taken
    drawn = np.empty(ends[-1], dtype=np.int32)
    for n, (place, edge) in enumerate(zip(places, edges, strict=True)):
        drawn[begin.take(place) + n] = edge
    unit = np.repeat(unit, taken)
    cuts = np.append(0, ends[np.cumsum(size) - 1])
    for (i, _, _), x, y in zip(batch, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        found[i].append((unit[x:y], drawn[x:y]))


class _Path:
    """A segmentation: unit and edge of each step, log-probability of each beginning."""

    __slots__ = ("edges", "phi", "units")

    def __init__(self, table: Compiled, units: np.ndarray, edges: np.ndarray):
        self.units, self.edges = units, edges
        self.phi = np.zeros(len(edges) + 1)
        np.cumsum(table.logp.take(edges), out=self.phi[1:])


class _Search:
    """Perturbed best-first search over one text.

    The queue holds disjoint sets of segmentations, each with the largest perturbed
    log-probability in it: the bound of the set, exact and known before its segmentation is.
    A set is all that leaves a known path in the steps from ``low`` to ``high``, or all that
    goes on with one of some edges after a beginning of a path. Taking the best set finds
    the segmentation that has this value, drawn from the set by probability, and cuts what
    is left of the set into new sets with values below (Gumbel values of known maximum).
    """

    def __init__(self, table: Compiled, key: int, units: np.ndarray):
        self.table, self.key, self.units, self.draws = table, key, units, 0
        self.queue: list[tuple] = []
        self.found: list[_Path] = []
        self.value = -math.log(-math.log(self.uniform()))

    def uniform(self) -> float:
        self.draws += 1
        x = xxhash.xxh64_intdigest(b"%d/%d" % (self.key, self.draws))
        return ((x >> 11) + 0.5) * 2.0**-53

    def push(self, log_mass: float, node: tuple) -> None:
        if log_mass == -math.inf:
            return
        g = log_mass - math.log(-math.log(self.uniform()))
        top, low = max(-self.value, -g), min(-self.value, -g)
        heapq.heappush(self.queue, (top + math.log1p(math.exp(low - top)), self.draws, node))

    def add(self, path: _Path, low: int) -> None:
        """A segmentation is found; all else that begins like its first ``low`` steps is open."""
        self.found.append(path)
        self.push_range(path, low, len(path.edges))

    def push_range(self, path: _Path, low: int, high: int) -> None:
        x = path.phi[high] - path.phi[low]
        if x < 0:
            self.push(path.phi[low] + math.log(-math.expm1(x)), (path, low, high, None))

    def pop(self) -> tuple | None:
        """Beginning (units, edges) of the best open segmentation, with the step it leaves at."""
        if not self.queue:
            return None
        bound, _, (path, low, high, open_) = heapq.heappop(self.queue)
        self.value = -bound
        table = self.table
        if open_ is None:
            phi = path.phi
            u = self.uniform()
            target = phi[low] + math.log1p(u * math.expm1(phi[high] - phi[low]))
            # The first step whose log-probability falls below the target.
            step = low + int(np.searchsorted(-phi[low + 1 : high + 1], -target, "right"))
            step = min(step, high - 1)
            while table.logp[path.edges[step]] == 0:
                step -= 1
            self.push_range(path, low, step)
            self.push_range(path, step + 1, high)
            taken = int(path.edges[step])
            state = int(table.to[path.edges[step - 1]]) if step else -1
            if state < 0:
                state = int(table.start[self.units[path.units[step]]])
            last = state
            while table.upto[last] < 2.0:
                last += 1
            open_ = [e for e in range(state, last + 1) if e != taken]
        else:
            step = low
        weight = np.exp(table.logp.take(open_))
        u = self.uniform() * weight.sum()
        at = min(int(np.searchsorted(weight.cumsum(), u, "right")), len(open_) - 1)
        edge = open_.pop(at)
        if open_:
            mass = float(np.delete(weight, at).sum())
            if mass > 0:
                self.push(float(path.phi[step]) + math.log(mass), (path, step, step, open_))
        edges = path.edges[: step + 1].copy()
        edges[step] = edge
        return path.units[: step + 1], edges


def log_inclusion(phi: float, kappa: float) -> float:
    """Log of the probability that a segmentation exceeds the threshold kappa."""
    x = phi - kappa
    if x > 30:
        return 0.0
    return float(x if x < -30 else math.log(-math.expm1(-math.exp(x))))


@lru_cache(maxsize=2)
def _compiled(model: bytes, alpha: float) -> Compiled:
    """The units compiled so far; a worker keeps them from task to task, up to ``KNOWN``."""
    return Compiled(Pieces(model, alpha))


def segmentations(table: Compiled, texts: list[tuple[int, str]], samples: int) -> list[list[tuple]]:
    """For each (seed, text) up to ``samples`` tuples (ids, log-probability, log-inclusion)."""
    if table.chars > KNOWN:
        table.forget()
    units, ends = _split([_line(t) for _, t in texts])
    parts = np.split(table.look_up(units), ends[:-1])
    searches = [_Search(table, key, p) for (key, _), p in zip(texts, parts, strict=True)]
    none = np.zeros(0, dtype=np.int32)
    begun = [(s, none, none) for s in searches]
    for round_ in range(samples):
        jobs = []
        for s, head_units, head_edges in begun:
            unit, state = 0, -1
            if len(head_edges):
                unit, state = int(head_units[-1]), int(table.to[head_edges[-1]])
                unit += state < 0
            seed = xxhash.xxh64_intdigest(b"%d:%d" % (s.key, round_))
            jobs.append((s.units, seed, unit, state))
        for (s, hu, he), (u, e) in zip(begun, _follow(table, jobs), strict=True):
            path = _Path(table, np.concatenate([hu, u]), np.concatenate([he, e]))
            s.add(path, len(he))
        if round_ + 1 < samples:
            begun = [(s, *got) for s in searches if (got := s.pop())]
    ids = iter(table.ids_of([p.edges for s in searches for p in s.found]) if searches else ())
    found = []
    for s in searches:
        kappa = -s.queue[0][0] if s.queue else -math.inf
        drawn = []
        for p in s.found:
            phi = float(p.phi[-1])
            drawn.append((next(ids), phi, 0.0 if kappa == -math.inf else log_inclusion(phi, kappa)))
        found.append(drawn)
    return found


def encode_samples(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    samples: int = SAMPLES,
    model_file: str = MODEL,
    alpha: float = 1.0,
    seed: int = 0,
    chars: int = 1_000_000,
) -> DataFrame:
    """Up to ``samples`` rows for each row: the input's columns but the text, ``sample`` (from
    1, by descending perturbed log-probability), ``ids``, ``log_prob``, ``log_inclusion`` and
    ``restored`` (the ids decode to the text).

    The segmentations of a row are distinct and drawn without replacement from the
    distribution that the pieces' probabilities give all segmentations of the whole text,
    sharpened by ``alpha``. ``log_inclusion`` is the log of the probability that a
    segmentation is among the drawn, given the threshold: the value of the best one left
    out (zero if none is left). The seed is the row's id and ``seed``, so repeated rows and
    reruns agree, and null ids count as one id.

    A null or empty text has one segmentation, without ids. Texts with fewer segmentations
    than asked for return all of them. Input columns named like an output are replaced. No
    shuffle; a task holds ``chars`` characters, or one text, at a time. The model file is
    read where the driver runs and sent to the executors (its size is that of a vocabulary).
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    outputs = ["sample", "ids", "log_prob", "log_inclusion", "restored"]
    row, names = pack(docs, [text_column, *outputs])
    source = docs.select(
        row.alias("_row"),
        F.col(f"`{id_column}`").cast("string").alias("_key"),
        F.col(f"`{text_column}`").alias("_text"),
    )
    schema = T.StructType(
        [
            source.schema["_row"],
            T.StructField("sample", T.IntegerType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("log_prob", T.DoubleType()),
            T.StructField("log_inclusion", T.DoubleType()),
            T.StructField("restored", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _compiled(model.value, alpha)

        def sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            keys = [
                xxhash.xxh64_intdigest(f"{seed}/{k}") for k in batch.column("_key").to_pylist()
            ]
            begin = 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end]) <= chars):
                    held += len(texts[end])
                    end += 1
                found = segmentations(
                    table, list(zip(keys[begin:end], texts[begin:end], strict=True)), samples
                )
                yield _batch(batch, begin, texts, found, table.pieces)
                begin = end

        for batch in batches:
            yield from sampled(batch)
            batch = None
        _give_back()

    out = source.mapInArrow(run, schema)
    return out.select(*unpack(names), *outputs)


def _batch(batch, begin, texts, found, pieces) -> pa.RecordBatch:
    take, rank, ids, phi, inclusion = [], [], [], [], []
    for i, drawn in enumerate(found):
        for r, (own, p, q) in enumerate(drawn):
            take.append(begin + i)
            rank.append(r + 1)
            ids.append(own)
            phi.append(p)
            inclusion.append(q)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    data, places = pieces.spell(flat)
    cuts = places[ends].tolist()
    lines = {i: _line(texts[i]) for i in set(take)}
    restored = [
        y - x == len(lines[i]) and data.startswith(lines[i], x)
        for i, x, y in zip(take, cuts[:-1], cuts[1:], strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_row").take(pa.array(take, pa.int64())),
            pa.array(rank, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
            pa.array(phi, pa.float64()),
            pa.array(inclusion, pa.float64()),
            pa.array(restored, pa.bool_()),
        ],
        names=["_row", "sample", "ids", "log_prob", "log_inclusion", "restored"],
    )
