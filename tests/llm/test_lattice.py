import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from metricloom.llm import lattice
from tests.llm.support import hard_docs, hard_texts


@pytest.fixture(scope="module")
def table():
    with open(lattice.MODEL, "rb") as f:
        return lattice.Compiled(lattice.Pieces(f.read()))


def all_ways(pieces, text):
    """Every segmentation of a text and its log-probability, piece by piece."""
    line = lattice.SPACE + text.replace(" ", lattice.SPACE)
    names = {p: i for i, p in enumerate(pieces.names) if pieces.logp[i]}

    def ways(at):
        if at == len(line):
            yield (), 0.0
            return
        known = False
        for end in range(at + 1, min(len(line), at + pieces.longest) + 1):
            i = names.get(line[at:end])
            if i is not None:
                known |= end == at + 1
                for rest, p in ways(end):
                    yield (i, *rest), p + pieces.logp[i]
        if not known:
            ids = tuple(pieces.byte_ids[b] for b in line[at].encode())
            for rest, p in ways(at + 1):
                yield ids + rest, p + len(ids) * pieces.byte_logp

    found = list(ways(0))
    total = math.log(sum(math.exp(p) for _, p in found))
    return {ids: p - total for ids, p in found}


@pytest.mark.parametrize("text", ["then", "a b", "the\nend", "né ①", "x"])
def test_all_segmentations_by_force(table, text):
    want = all_ways(table.pieces, text)
    got = lattice.segmentations(table, [(3, text)], len(want) + 5)[0]
    assert {tuple(ids.tolist()) for ids, _, _ in got} == set(want)
    assert len(got) == len(want)
    for ids, p, inclusion in got:
        assert abs(p - want[tuple(ids.tolist())]) < 1e-9 and inclusion == 0
        assert table.pieces.decode(ids) == text


def test_distribution_without_replacement(table):
    """Orders of the first two and inclusion weights follow the exact probabilities."""
    text, n = "then a", 12_000
    want = {k: math.exp(p) for k, p in all_ways(table.pieces, text).items()}
    keys = [xxhash.xxh64_intdigest(str(i)) for i in range(n)]
    drawn = lattice.segmentations(table, [(k, text) for k in keys], 2)
    pairs = Counter(tuple(tuple(ids.tolist()) for ids, _, _ in d) for d in drawn)
    weight = Counter()
    for d in drawn:
        for ids, _, inclusion in d:
            weight[tuple(ids.tolist())] += 1 / math.exp(inclusion) / n
    top = sorted(want, key=want.get, reverse=True)[:4]
    for a, b in itertools.permutations(top, 2):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    for a in top[:3]:
        assert abs(weight[a] - 1) < 0.1


def test_values_fall_and_scores_are_log_inclusions(table):
    d = lattice._Search(table, 5, table.look_up(table.pieces.units("some rather longer words here")))
    path = lattice._follow(table, [(d.units, 9, 0, -1)])[0]
    d.add(lattice._Path(table, *path), 0)
    values = [d.value]
    for _ in range(6):
        units, edges = d.pop()
        values.append(d.value)
        state = int(table.to[edges[-1]])
        u, e = lattice._follow(table, [(d.units, 9, int(units[-1]) + (state < 0), state)])[0]
        d.add(lattice._Path(table, np.append(units, u), np.append(edges, e)), len(edges))
    assert values == sorted(values, reverse=True)
    assert len({tuple(p.edges.tolist()) for p in d.found}) == 7
    assert lattice.log_inclusion(-1000.0, -3.0) == -997.0
    assert lattice.log_inclusion(0.0, -50.0) == 0.0


def test_slices_and_batches_agree(table, monkeypatch):
    texts = [(i, " ".join(["many different", "words", str(i)] * 40)) for i in range(6)]
    one = [lattice.segmentations(table, [t], 3)[0] for t in texts]
    monkeypatch.setattr(lattice, "UNITS", 17)
    for a, b in zip(one, lattice.segmentations(table, texts, 3), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x[0].tolist() == y[0].tolist() and abs(x[1] - y[1]) < 1e-9


def test_hard_cases(spark):
    docs = hard_docs(spark, hard_texts())
    found = lattice.encode_samples(docs, samples=2)
    outputs = ["sample", "ids", "log_prob", "log_inclusion", "restored"]
    assert found.columns == ["doc_id", "lang", "_row", "score", "a.b", "k0", *outputs]
    rows = found.collect()
    assert all(r["restored"] for r in rows)
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [(r["ids"], r["log_prob"], r["log_inclusion"]) for r in empty] == [([], 0.0, 0.0)] * 2
    same = {(r["sample"], tuple(r["ids"])) for r in rows if r["doc_id"] == 4}
    assert len(same) == 2  # repeated rows draw the same
    by_key = Counter((r["doc_id"], r["sample"], tuple(r["ids"])) for r in rows if r["doc_id"] == 6)
    assert len(by_key) == 2
    again = lattice.encode_samples(docs.repartition(1), samples=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert lattice.encode_samples(docs.limit(0)).count() == 0


def test_room_not_used_yet_takes_no_memory():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = lattice._Grown(np.float64)
    held.add(np.ones(1 << 23))
    before = resident()
    held.add(np.ones(1))
    assert len(held.data) == 1 << 24 and held.size == (1 << 23) + 1 and held.data[: held.size].all()
    assert resident() - before < 32 << 20  # the room is 64 MB


@pytest.mark.parametrize("texts", [[""], ["", "a", ""], ["\n\n \n  x  y\t ", "▁ né\U0001f642  \n"], ["  ", "\n"]])
def test_units_of_many_texts_at_once(texts):
    words = re.compile(r"\n| *[^ \n]+| +")
    want = [words.findall(" " + t) if t else [] for t in texts]
    units, ends = lattice._split([lattice._line(t) for t in texts])
    assert [u.decode() for u in units.to_pylist()] == [u for us in want for u in us]
    assert ends.tolist() == np.cumsum([len(us) for us in want]).tolist()


def test_work_follows_distinct_words_and_beginnings_of_pieces(table, monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own = lattice.Compiled(table.pieces)
    own.number = Counted()
    own.look_up(table.pieces.units("same word " * 1000))
    assert own.number.asked < 10  # of 2000 units
    hashed, roll = [], lattice.Pieces.roll
    monkeypatch.setattr(
        lattice.Pieces, "roll", staticmethod(lambda h, c: hashed.append(len(c)) or roll(h, c))
    )
    own.look_up(table.pieces.units("zqx" * 1000))
    assert sum(hashed) < 5 * 3001  # not every substring of up to 16 characters


def test_what_is_kept_when_units_are_forgotten_is_compiled_still(table, monkeypatch):
    monkeypatch.setattr(lattice, "KNOWN", 400)
    monkeypatch.setattr(lattice, "TOGETHER", 7)
    text = " ".join(f"word{i} né ①" for i in range(60))
    want = lattice.segmentations(table, [(9, text)], 3)[0]
    own = lattice.Compiled(table.pieces)
    for i in range(5):
        lattice.segmentations(own, [(i, f"a{i} b{i} " + " ".join(f"n{j + 37 * i}" for j in range(40)))], 2)
        got = lattice.segmentations(own, [(9, text)], 3)[0]
        for x, y in zip(want, got, strict=True):
            assert x[0].tolist() == y[0].tolist() and x[1:] == y[1:]
        assert len(own.number) == own._start.size and own.chars == sum(len(u.decode()) for u in own.number)
