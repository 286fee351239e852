"""Copies of benchmark items in documents: n-gram seeds, then local alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import digest, pack, unpack
from metricloom.session import pin

GRAM = 4
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the filter that the documents' n-grams pass before they are shuffled: 8 MB.
FILTER_BITS = 26
_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_hashes(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of all n-grams in order."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    own = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    last = len(own) - n + 1
    h = np.full(last, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ own[i : i + last]) * _STEP
        h ^= h >> np.uint64(29)
    return h


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each hash."""
    shift = np.uint64(64 - FILTER_BITS)
    return h >> shift, (h * _STEP) >> shift


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two sequences of word numbers, and the (first, last) place of
    the best alignment in the passage. A row of the table is one vector operation: a gap
    along the passage is a running maximum."""
    steps = -GAP * np.arange(len(passage))
    row = np.zeros(len(passage), dtype=np.int64)
    begun = np.arange(len(passage))
    best, first, last = 0, 0, 0
    for word in item:
        score = np.where(passage == word, MATCH, MISMATCH)
        from_left = np.concatenate([[0], row[:-1]]) + score
        start_left = np.concatenate([[0], begun[:-1]])
        fresh = np.concatenate([[True], row[:-1] == 0])
        start_left = np.where(fresh, np.arange(len(passage)), start_left)
        from_above = row + GAP
        new = np.maximum(np.maximum(from_left, from_above), 0)
        start = np.where(new == from_left, start_left, begun)
        reach = new + steps
        top = np.maximum.accumulate(reach)
        # Where the running maximum was set: the start of the gap that reaches here.
        at = np.maximum.accumulate(np.where(reach == top, np.arange(len(passage)), 0))
        row, begun = top - steps, start[at]
        end = int(row.argmax())
        if row[end] > best:
            best, first, last = int(row[end]), int(begun[end]), end
    return best, first, last


def alignment(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Share of the score that a whole copy of the item would have, and its place."""
    if not item or not passage:
        return 0.0, 0, 0
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x]) for x in (item, passage))
    score, first, last = align(a, b)
    return score / (MATCH * len(item)), first, last


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(key, item, words) of the items that have words, repeats once; ids may be null."""

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(words_of)

    return (
        benchmark.select(F.col(f"`{id_column}`").alias("item"), F.col(f"`{text_column}`").alias("t"))
        .distinct()
        .select("item", split("t").alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("key", F.xxhash64("item", "words"))
    )


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(key, size, at, gram): the n-grams of each item; shorter items are one gram whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, words in zip(b["key"], b["words"], strict=True):
                words = list(words)
                size = min(n, len(words))
                h = gram_hashes(words, size)
                yield pd.DataFrame(
                    {"key": key, "size": size, "at": np.arange(len(h)), "gram": h.view(np.int64)}
                )

    return items.select("key", "words").mapInPandas(run, "key long, size int, at int, gram long")


def _filter(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' slots, built where the grams are; 8 MB however many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = np.concatenate(_slots(b["gram"].to_numpy().view(np.uint64)))
            yield pd.DataFrame({"slot": np.unique(slots).astype(np.int64) + 1})

    rows = (
        grams.select("gram")
        .mapInPandas(run, "slot long")
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    bits = np.zeros(2**FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _regions(docs: DataFrame, sizes: list[int], reach: int, bits) -> DataFrame:
    """(id, k0, k1, at, words, grams): the parts of documents around n-grams that pass the
    filter, ``reach`` words to either side, overlapping parts joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bits.value
        for b in batches:
            for x in b.itertuples(index=False):
                words = words_of(x.text)
                hits, grams = [], []
                for n in sizes:
                    h = gram_hashes(words, n)
                    s, t = _slots(h)
                    on = (known[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
                    on &= (known[t >> np.uint64(3)] >> (t & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.flatnonzero(on)
                    hits.append(at)
                    grams.append(h[at])
                at, h = np.concatenate(hits), np.concatenate(grams)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                rows = []
                for part, own in zip(np.split(at, cuts), np.split(h, cuts), strict=True):
                    low = max(0, int(part[0]) - reach)
                    high = min(len(words), int(part[-1]) + max(sizes) + reach)
                    rows.append((x.id, x.k0, x.k1, low, words[low:high], np.unique(own).view(np.int64)))
                yield pd.DataFrame(rows, columns=["id", "k0", "k1", "at", "words", "grams"])

    # Ids go through Python as texts, so that nulls and large numbers stay what they are.
    found = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(
        run, "id string, k0 long, k1 long, at int, words array<string>, grams array<long>"
    )
    return found.withColumn("id", F.col("id").cast(docs.schema["id"].dataType))


def _found(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str,
    text_column: str,
    item_column: str,
    item_text_column: str,
    n: int,
    threshold: float,
) -> DataFrame:
    """(id, k0, k1, item, score, first, last) of each region that holds an item."""
    spark = docs.sparkSession
    items = pin(_items(benchmark, item_column, item_text_column))
    grams = pin(_item_grams(items, n))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # n at most
    bits = spark.sparkContext.broadcast(_filter(grams))
    text = F.col(f"`{text_column}`")
    key = F.col(f"`{id_column}`")
    rows = docs.select(
        key.alias("id"), text.alias("text"), *[h.alias(f"k{i}") for i, h in enumerate(digest(key, text))]
    )
    if not sizes:
        rows = rows.limit(0)
    # Inserted words may stretch a copy by half.
    regions = _regions(rows, sizes or [n], longest + longest // 2, bits)
    parts = digest(F.col("words"))
    regions = pin(regions.select("*", parts[0].alias("r0"), parts[1].alias("r1")))
    hits = regions.select("r0", "r1", F.explode("grams").alias("gram"))
    # Equal regions, as copies of documents have, are aligned once.
    # Every n-gram of an item is a seed: which of them a copy has kept is not known beforehand.
    seeds = grams.select("gram", "key").distinct()
    pairs = hits.distinct().join(seeds, "gram").select("r0", "r1", "key").distinct()
    passages = regions.groupBy("r0", "r1").agg(F.first("words").alias("passage"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                # The score is at most the share of the item's words that the passage has.
                has = set(x.passage)
                if sum(w in has for w in x.words) < threshold * len(x.words):
                    continue
                score, first, last = alignment(list(x.words), list(x.passage))
                if score >= threshold:
                    out.append((x.r0, x.r1, x.key, score, first, last))
            yield pd.DataFrame(out, columns=["r0", "r1", "key", "score", "first", "last"])

    matched = (
        pairs.join(items, "key")
        .join(passages, ["r0", "r1"])
        .select("r0", "r1", "key", "words", "passage")
        .mapInPandas(run, "r0 long, r1 long, key long, score double, first int, last int")
        .join(items.select("key", "item"), "key")
    )
    return regions.select("id", "k0", "k1", "at", "r0", "r1").join(matched, ["r0", "r1"]).select(
        "id", "k0", "k1", "item", "score", (F.col("at") + F.col("first")).alias("first"),
        (F.col("at") + F.col("last")).alias("last"),
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    n: int = GRAM,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, item, score, first_word, last_word): the documents that hold a copy of an item,
    whole or edited, and where its best copy stands.

    Words are runs of letters and digits, lower-cased. Every n-gram of an item is a seed,
    so a copy is found if ``n`` words of it in a row stand unchanged anywhere; items shorter
    than ``n`` are one seed. The region of a document around a seed, as wide as any item and half as much
    again, is aligned with the item (match 2, other word -1, gap -1); the score is the share
    of what the whole item would give, and a pair counts from ``threshold``.

    Null and empty texts hold nothing; an item without words is in no document. Rows of one
    id count as one document, repeated items as one; null ids are an id. An empty table on
    either side gives an empty result.

    Documents' n-grams meet a filter of fixed size before anything is shuffled, and only
    regions around n-grams of the benchmark are. A passage in very many documents is a
    frequent key of the join with the items' seeds, which AQE splits or broadcasts.
    """
    found = _found(
        docs, benchmark, id_column, text_column, item_column, item_text_column, n, threshold
    )
    best = found.groupBy("id", "item").agg(
        F.max(F.struct("score", (-F.col("first")).alias("before"), "last")).alias("b")
    )
    return best.select(
        F.col("id").alias(id_column),
        F.col("item").alias(item_column),
        F.col("b.score").alias("score"),
        (-F.col("b.before")).alias("first_word"),
        F.col("b.last").alias("last_word"),
    )


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    n: int = GRAM,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows whose text holds no item, with their columns as they were."""
    found = _found(
        docs, benchmark, id_column, text_column, item_column, item_text_column, n, threshold
    )
    row, names = pack(docs, [])
    key, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    keyed = docs.select(
        row.alias("_row"), *[h.alias(f"k{i}") for i, h in enumerate(digest(key, text))]
    )
    return keyed.join(found.select("k0", "k1").distinct(), ["k0", "k1"], "left_anti").select(
        *unpack(names)
    )
