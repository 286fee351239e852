"""Documents packed into sequences: first-fit decreasing by a tournament tree of capacities."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import pack, unpack

TOKENIZER = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
GROUP = 1024
#: A worker forgets the rarer half of its words beyond this number, and encodes so many
#: characters at a time.
KNOWN, CHARS = 900_000, 5_000_000
# Fixed value: how tokenizers of this kind cut a text into parts, after dropping white space.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for words of printable ASCII and Latin-1 letters, in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+").findall


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as byte-level models spell them: a printable character for each byte
    of UTF-8, its own where the byte is a printable one, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in plain}
    spelled |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in spelled)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Words:
    """Token ids of texts, by their words.

    A tokenizer that cuts texts into ``PARTS`` joins nothing across white space, so the ids
    of a text are those of its words in turn. Words are encoded once and kept; plain ones by
    the tokenizer's model alone, all others by the whole tokenizer. A tokenizer of another
    kind gets whole texts.
    """

    def __init__(self, model: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_str(model)
        config = json.loads(model)
        cut = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = cut[0].get("pattern") == {"Regex": PARTS} and kinds == ["NFC", "Replace", "Lowercase"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in config.get("added_tokens", [])) or "$.")
        self.letters = _byte_letters()
        self.number: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.first = self.size = np.zeros(0, dtype=np.int64)

    def forget(self) -> None:
        """Back to the words met first, among which are the frequent ones."""
        kept = KNOWN // 2
        self.number = {w: n for w, n in self.number.items() if n < kept}
        self.parts = {}
        self.flat = self.flat[: self.first[kept]].copy()
        self.first, self.size = self.first[:kept].copy(), self.size[:kept].copy()

    def _plain(self, word: str) -> list[int]:
        ids = []
        for part in _PLAIN_PARTS(word.lower()):
            own = self.parts.get(part)
            if own is None:
                spelled = part if part.isascii() else part.translate(self.letters)
                own = self.parts[part] = [t.id for t in self.tokenizer.model.tokenize(spelled)]
            ids += own
        return ids

    def _learn(self, words: list[str]) -> None:
        found: list[list[int]] = []
        rest = []
        special = self.special.search
        for i, word in enumerate(words):
            plain = _PLAIN(word) and not ("<" in word and special(word))
            found.append(self._plain(word) if plain else [])
            if not plain:
                rest.append(i)
        for i, e in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            found[i] = e.ids
        begin, end = len(self.number), len(self.flat)
        self.number.update(zip(words, range(begin, begin + len(words)), strict=True))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum()))
        self.first = np.concatenate([self.first, end + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def _whole(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an array without nulls."""
        if not self.by_word:
            return [np.array(e.ids, dtype=np.int32) for e in self._whole(texts.to_pylist())]
        if len(self.number) > KNOWN:
            self.forget()
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends = words.value_lengths().to_numpy().cumsum()
        each = words.flatten().dictionary_encode()
        own = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in own if w not in self.number]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.number.__getitem__, own), dtype=np.int64, count=len(own))
        which = known[each.indices.to_numpy()]
        size = self.size[which]
        upto = size.cumsum()
        at = np.repeat(self.first[which] - (upto - size), size)
        at += np.arange(len(at))
        ids = self.flat[at]
        cuts = np.append(0, upto)[ends].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


@lru_cache(maxsize=2)
def _words(model: str) -> Words:
    return Words(model)


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The first bin with room for each item, in the order given.

    A tournament tree holds the capacities left: each node the larger of its two, the leaves
    one bin each. An item goes left wherever the left half has a bin that takes it.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * leaves)
    bins = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


def pack_group(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for the items of a group, none larger than ``room``.

    First-fit decreasing; then the emptiest sequences are cut into the gaps of the others, as
    long as these can take them whole.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = first_fit([sizes[i] for i in order], room)
    packed: list[list[tuple[int, int, int]]] = [[] for _ in range(max(bins, default=-1) + 1)]
    for item, b in zip(order, bins, strict=True):
        packed[b].append((item, 0, sizes[item]))
    used = [sum(n for _, _, n in p) for p in packed]
    by_use = sorted(range(len(packed)), key=lambda b: (used[b], b))
    gaps = room * len(packed) - sum(used)
    # The largest gaps first: by_use is walked from its start behind the sequences taken apart.
    for at, donor in enumerate(by_use):
        if gaps - (room - used[donor]) < used[donor]:
            break
        gaps -= room
        rest = packed[donor]
        packed[donor] = []
        for to in by_use[at + 1 :]:
            while rest and used[to] < room:
                item, start, n = rest.pop()
                take = min(n, room - used[to])
                packed[to].append((item, start, take))
                used[to] += take
                if take < n:
                    rest.append((item, start + take, n - take))
            if not rest:
                break
    return [p for p in packed if p]


def _batch(rows: pa.Array, found: list[tuple], derive: dict | None) -> pa.RecordBatch:
    """A record for each (row, start, ids, doc_tokens, sequence, offset)."""
    take, start, ids, tokens, sequence, offset = zip(*found, strict=True)
    numbers = {"start": start, "doc_tokens": tokens, "sequence_id": sequence, "offset": offset}
    columns = {"_row": rows.take(pa.array(take, pa.int64()))}
    columns |= {name: pa.array(values, pa.int64()) for name, values in numbers.items()}
    if derive is None:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
    for name, function in (derive or {}).items():
        columns[name] = pa.array(map(function, ids), pa.int64())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class _Group:
    """The open group of a task: what is left of its documents after whole sequences."""

    def __init__(self, number: int, length: int):
        self.number, self.length, self.sequences = number, length, 0
        self.rows: list[pa.Array] = []
        self.items: list[tuple[int, np.ndarray, int]] = []  # start, ids, doc_tokens

    def next(self) -> int:
        self.sequences += 1
        return (self.number << 32) + self.sequences - 1

    def close(self, derive: dict | None) -> Iterator[pa.RecordBatch]:
        if not self.items:
            return
        found = []
        for parts in pack_group([len(ids) for _, ids, _ in self.items], self.length):
            sequence, offset = self.next(), 0
            for item, a, n in parts:
                start, ids, tokens = self.items[item]
                found.append((item, start + a, ids[a : a + n], tokens, sequence, offset))
                offset += n
        rows = pa.concat_arrays(self.rows)
        for at in range(0, len(found), 512):
            yield _batch(rows, found[at : at + 512], derive)


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    tokenizer_file: str | None = None,
    end_id: int = END_ID,
    group: int = GROUP,
    seed: int = 0,
    derive: dict[str, Callable[[np.ndarray], int]] | None = None,
) -> DataFrame:
    """A row for each piece of a document: the input's columns but the text, ``start`` (the
    document's ids before it), ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``. With
    ``derive``, the whole numbers that its functions make of a piece's ids come instead of
    these, made in the same task.

    A document is the ids of its whole text and ``end_id``; a null or empty text is the end
    id alone. Documents are cut into whole sequences of ``length`` and a remainder. Rows are
    dealt at random into groups of about ``group``; the remainders of a group are packed by
    first-fit decreasing over a tournament tree, its emptiest sequences then cut into the
    gaps of the others, so a group pads less than one sequence or so. Groups know nothing of
    each other. Offsets of a sequence have no gaps, its number holds that of the group.

    Every row of an input with repeated rows or null ids is a document of its own: the group
    comes from a hash of the id, the row's place in the input and ``seed``, so no id or copy
    is too large for a group. The input has to give its rows in the same order when it is
    read again, as files do. Input columns named like an output are replaced; an empty input
    gives no rows.

    Texts are shuffled once, and encoded behind the shuffle. A task holds the ids of at most
    ``group`` remainders, and the ids of one batch of texts. The tokenizer file is read where
    the driver runs and sent to the executors (its size is that of a vocabulary).
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    numbers = ["start", "doc_tokens", "sequence_id", "offset", *(derive or {})]
    outputs = numbers if derive is not None else [*numbers, "ids"]
    row, names = pack(docs, [text_column, *outputs])
    groups = max(1, -(-docs.count() // group))
    tasks = max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    key = F.xxhash64(F.col(f"`{id_column}`"), F.monotonically_increasing_id(), F.lit(seed))
    dealt = (
        docs.select(row.alias("_row"), F.col(f"`{text_column}`").alias("_text"), key.alias("_key"))
        .withColumn("_group", F.pmod("_key", F.lit(groups)))
        .repartition(min(groups, max(tasks, groups // 32)), "_group")
        .sortWithinPartitions("_group", "_key")
    )
    schema = T.StructType([dealt.schema["_row"]] + [T.StructField(n, T.LongType()) for n in numbers[:4]])
    if derive is None:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    for name in derive or {}:
        schema = schema.add(name, T.LongType())
    end = np.array([end_id], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, open_ = _words(model.value), None
        for batch in batches:
            texts = batch.column("_text").fill_null("")
            lengths = pc.utf8_length(texts).to_pylist()
            numbers = batch.column("_group").to_pylist()
            rows = batch.column("_row")
            begin = 0
            while begin < len(texts):
                stop, held = begin, 0
                while stop < len(texts) and (stop == begin or held + lengths[stop] <= CHARS):
                    held += lengths[stop]
                    stop += 1
                whole, kept = [], []
                for i, ids in enumerate(words.encode(texts.slice(begin, stop - begin)), begin):
                    if open_ is None or open_.number != numbers[i]:
                        if open_ is not None:
                            open_.rows.append(rows.take(pa.array(kept, pa.int64())))
                            yield from open_.close(derive)
                        open_, kept = _Group(numbers[i], length), []
                    ids = np.concatenate([ids, end])
                    cut = len(ids) // length * length
                    for a in range(0, cut, length):
                        whole.append((i, a, ids[a : a + length], len(ids), open_.next(), 0))
                    if cut < len(ids):
                        kept.append(i)
                        open_.items.append((cut, ids[cut:].copy(), len(ids)))
                open_.rows.append(rows.take(pa.array(kept, pa.int64())))
                for at in range(0, len(whole), 512):
                    yield _batch(rows, whole[at : at + 512], derive)
                begin = stop
        if open_ is not None:
            yield from open_.close(derive)

    return dealt.select("_row", "_text", "_group").mapInArrow(run, schema).select(*unpack(names), *outputs)
