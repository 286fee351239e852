"""Near-duplicates by SimHash: fingerprints, tiled comparison, groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import digest, pack, unpack
from metricloom.llm.components import components
from metricloom.session import pin

BITS = 64
RADIUS = 3
SHINGLE = 3
TILE = 1024
SEED = 42


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of the shingles of a text in order; a shorter text is one shingle.

    Bytes are lower-cased and split, which touches A-Z and ASCII white space only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.array(
        [hashed(line[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)],
        dtype=np.uint64,
    )


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the shingles of a text, repeats included; zero without words."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    # Long texts are tallied in bounded slices.
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of the links that first connect their ends, among n nodes."""
    root = list(range(n))
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def compare_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Links between two tiles (or within one) of fingerprints, enough to connect all that
    the links within ``radius`` bits connect. Tiles are sorted by their bit counts."""
    found_a, found_b = [], []
    other = left if right is None else right
    if right is None and len(left) <= 64:
        near = np.triu(np.bitwise_count(left[:, None] ^ left) <= radius, 1)
        a, b = np.nonzero(near)
        kept = _forest(a, b, len(left)) if len(a) > 1 else slice(None)
        return np.stack([left[a[kept]], left[b[kept]]], axis=1)
    ones_a, ones_b = np.bitwise_count(left), np.bitwise_count(other)
    # A row meets the part of the other tile whose bit counts are within the radius.
    low = np.searchsorted(ones_b, ones_a.astype(np.int64) - radius, "left")
    high = np.searchsorted(ones_b, ones_a.astype(np.int64) + radius, "right")
    for i in range(0, len(left), 64):
        rows = left[i : i + 64]
        a, b = low[i], high[min(i + 64, len(left)) - 1]
        if a >= b:
            continue
        near = np.bitwise_count(rows[:, None] ^ other[None, a:b]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + a
        if right is None:
            keep = x < y
            x, y = x[keep], y[keep]
        found_a.append(x)
        found_b.append(y)
    if not found_a:
        return np.zeros((0, 2), dtype=np.uint64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    kept = _forest(a, b if right is None else b + len(left), len(left) + len(other))
    return np.stack([left[a[kept]], other[b[kept]]], axis=1)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, enough to connect all pairs of
    at most ``radius`` differing bits.

    Two such prints agree in one of radius + 1 blocks of their bits at least, so prints that
    share a block's value form a tile group, for each block. A group is cut into tiles of
    ``tile`` prints by bit count; tile pairs whose bit counts differ by more than ``radius``
    are skipped, the others are compared whole by exclusive-or and bit counts, each pair as
    a row of its own, so a group of any size spreads over all tasks. A pair of tiles gives a
    spanning forest of its links, never all of them.
    """
    blocks = radius + 1
    width = -(-BITS // blocks)
    masks = [(1 << min(width, BITS - i * width)) - 1 for i in range(blocks)]
    spread = prints.select(
        "fp",
        F.bit_count("fp").alias("ones"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("block"),
                        F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND(F.lit(m)).alias("part"),
                    )
                    for i, m in enumerate(masks)
                ]
            )
        ).alias("k"),
    ).select("fp", "ones", F.col("k.block").alias("block"), F.col("k.part").alias("part"))
    # Tiles hold one bit count or a few: the rank of a group's bit counts comes from sums of
    # counts, at most 65 a group, and a print's tile within its bit count from its hash.
    counts = spread.groupBy("block", "part", "ones").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("block", "part").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("n")
    )
    groups = groups.where("size > 1")
    # Small groups are one tile. Large ones are cut at bit counts, and each count by hash.
    few = F.col("size") <= tile
    cuts = F.when(few, F.lit(1).cast("long")).otherwise(
        F.ceil(F.element_at("n", F.col("ones")) / F.lit(tile / 2)).cast("long")
    )
    dealt = spread.join(groups, ["block", "part"]).select(
        "block",
        "part",
        "fp",
        F.when(few, F.lit(0)).otherwise(F.col("ones")).alias("level"),
        F.pmod(F.xxhash64("fp"), cuts).alias("cut"),
        F.when(few, F.lit(None).cast("map<int,bigint>")).otherwise(F.col("n")).alias("n"),
    )
    # Few bytes but much work a tile: a fixed count of partitions keeps all cores busy.
    spark = prints.sparkSession
    tasks = max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    keys = ["block", "part", "level", "cut"]
    tiles = dealt.repartition(tasks, *keys).groupBy(*keys).agg(
        F.collect_list("fp").alias("fps"), F.first("n").alias("n")
    )
    return _pairs_of_tiles(tiles, radius, tile)


def _pairs_of_tiles(tiles: DataFrame, radius: int, tile: int) -> DataFrame:
    """Compare each tile with itself and with those after it that are near in bit count."""
    schema = "a long, b long"

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([compare_tiles(_sorted(fps), None, radius) for fps in batch["fps"]])

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = zip(batch["fps"], batch["others"], strict=True)
            yield _frame([compare_tiles(_sorted(x), _sorted(y), radius) for x, y in pairs])

    own = tiles.where(F.size("fps") > 1).select("fps").mapInPandas(within, schema)
    large = tiles.where("n IS NOT NULL")
    # The tiles after this one: the same bit count and a later cut, or up to radius bits more.
    ahead = large.select(
        "block",
        "part",
        F.col("level").alias("level_a"),
        F.col("cut").alias("cut_a"),
        F.col("fps"),
        F.explode(F.filter(F.map_entries("n"), lambda e: e["key"].between(F.col("level"), F.col("level") + radius))).alias("e"),
    ).select(
        "*",
        F.col("e.key").alias("level"),
        F.explode(
            F.sequence(
                F.lit(0).cast("long"), F.ceil(F.col("e.value") / F.lit(tile / 2)).cast("long") - 1
            )
        ).alias("cut"),
    ).where("level > level_a OR cut > cut_a")
    other = large.select("block", "part", "level", "cut", F.col("fps").alias("others"))
    pairs = ahead.join(other, ["block", "part", "level", "cut"]).select("fps", "others")
    return own.unionByName(pairs.mapInPandas(between, schema))


def _sorted(fps) -> np.ndarray:
    prints = np.asarray(fps, dtype=np.int64).view(np.uint64)
    return prints[np.argsort(np.bitwise_count(prints), kind="stable")]


def _frame(parts: list[np.ndarray]) -> pd.DataFrame:
    found = np.concatenate([np.zeros((0, 2), dtype=np.uint64), *parts])
    return pd.DataFrame({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})


def fingerprints(
    docs: DataFrame, text_column: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """The input with ``fp``, the SimHash of the whole text as a long; null texts have zero."""

    @F.pandas_udf("long")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            prints = np.array([fingerprint(t, shingle, seed) for t in s], dtype=np.uint64)
            yield pd.Series(prints.view(np.int64))

    row, names = pack(docs, ["fp"])
    return docs.select(row.alias("_row"), marks(f"`{text_column}`").alias("fp")).select(
        *unpack(names), "fp"
    )


def _grouped(docs: DataFrame, radius: int, shingle: int, tile: int) -> DataFrame:
    """(id, fp, group, least, k0, k1) for rows (id, text, k0, k1): ``group`` is a fingerprint
    that stands for the component, ``least`` its least id."""
    marked = pin(fingerprints(docs, "text", shingle).drop("text"))
    least = pin(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(least.select("fp"), radius, tile))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    moved = rooted.join(best, "root").select("fp", "root", "best")
    groups = least.join(moved, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("group"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("best")).alias("least"),
    )
    return marked.join(groups, "fp")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    tile: int = TILE,
) -> DataFrame:
    """(id, fp, component_id) for each row; ``component_id`` is the least id that links of at
    most ``radius`` differing bits reach.

    Texts without words have the fingerprint zero and link like any other. A row with a null
    id takes part and names no component, unless no row of it has an id: then the component
    is null. Repeated rows come back each. Other columns of the input are not read.

    Equal texts meet as one fingerprint, before anything is compared; only fingerprints,
    ids and counts are shuffled, texts never.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return _grouped(rows, radius, shingle, tile).select(
        F.col("id").alias(id_column), "fp", F.col("least").alias("component_id")
    )


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    tile: int = TILE,
) -> DataFrame:
    """One row of each group of near-duplicates, with its columns as they were.

    The row with the component's least id stays; of several rows with this id the one whose
    columns have the least digest, and one of rows that are equal throughout. A row without
    an id stays only where its group has none with one. Maps take no part in the digest.
    """
    return keep_groups(docs, id_column, text_column, lambda rows: _grouped(rows, radius, shingle, tile))


def keep_groups(
    docs: DataFrame, id_column: str, text_column: str, grouped: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The row that ``keep_one`` names of each group; ``grouped`` gives (id, group, k0, k1)
    for rows (id, text, k0, k1)."""
    row, names = pack(docs, [])
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.select(
        row.alias("_row"), *[h.alias(f"k{i}") for i, h in enumerate(digest(*hashable))]
    )
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        *[h.alias(f"k{i}") for i, h in enumerate(digest(*hashable))],
    )
    each = (
        grouped(rows)
        .groupBy("k0", "k1", "group")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    )
    first = each.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "k0", "k1", "n")).alias("w"))
    winners = pin(first.select("w.k0", "w.k1", "w.n"))
    kept = keyed.join(winners.where("n = 1"), ["k0", "k1"], "left_semi")
    equal = winners.where("n > 1")
    if not equal.isEmpty():
        again = keyed.join(equal, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"])
        kept = kept.unionByName(again)
    return kept.select(*unpack(names))
