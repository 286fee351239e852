"""Lines that several documents share, kept only where they stand first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import BLANKS, ascii_lower, digest, pack, unpack

MIN_CHARS = 10
MIN_DOCS = 2
LAST = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """A row for each line that can count: id, digest of the text, position, digest of the key."""
    text = F.col(f"`{text_column}`")
    lines = docs.select(
        _id(id_column).alias("id"),
        *[h.alias(f"t{i}") for i, h in enumerate(digest(text))],
        F.posexplode(_lines(text)).alias("pos", "line"),
    )
    keyed = lines.select(
        "id", "t0", "t1", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")
    ).where(F.length("key") >= min_chars)
    return keyed.select(
        "id", "t0", "t1", "pos", *[h.alias(f"h{i}") for i, h in enumerate(digest(F.col("key")))]
    )


def _id(id_column: str) -> Column:
    return F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST))


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """The input with the shared lines gone from ``text``, and ``n_lines``, ``n_dropped``.

    Lines are split at ``\\n``. A line's key is the line stripped of ASCII white space, A-Z
    lower-cased; keys travel as 128-bit digests. A key of at least ``min_chars`` characters
    in at least ``min_docs`` documents loses its lines everywhere but in the smallest id.
    Other lines stay as they are, in their order.

    A null text is one empty line and comes back as an empty text. Documents with a null id
    count as one document that comes last. Rows of one id are one document for the counting,
    and each comes back as a row of its own. Input columns named like an output are replaced.

    One key may be in most documents: the count combines before its shuffle, and the join
    that marks lines moves digests only, in a plain join that AQE can split.
    """
    text = F.col(f"`{text_column}`")
    keys = _keys(docs, id_column, text_column, min_chars)
    if min_docs == 2:
        span = keys.groupBy("h0", "h1").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        shared = span.where("first < last").select("h0", "h1", "first")
    else:
        each = keys.groupBy("h0", "h1", "id").agg(F.lit(1).alias("one"))
        shared = (
            each.groupBy("h0", "h1")
            .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_docs)
            .select("h0", "h1", "first")
        )
    drops = (
        keys.join(shared, ["h0", "h1"])
        .where("id <> first")
        .groupBy("id", "t0", "t1")
        .agg(F.collect_set("pos").alias("_drops"))
        .withColumnsRenamed({"id": "_id", "t0": "_t0", "t1": "_t1"})
    )
    row, names = pack(docs, [text_column, "n_lines", "n_dropped"])
    whole = docs.select(
        row.alias("_row"),
        _lines(text).alias("_lines"),
        _id(id_column).alias("_id"),
        *[h.alias(f"_t{i}") for i, h in enumerate(digest(text))],
    )
    joined = whole.join(drops, ["_id", "_t0", "_t1"], "left")
    # Positions, not membership tests: linear in the lines of a document.
    kept = F.array_except(
        F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drops", F.array().cast("array<int>"))
    )
    n_dropped = F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops"))
    return joined.select(
        *unpack(names),
        F.concat_ws("\n", F.transform(kept, lambda i: F.col("_lines")[i])).alias(text_column),
        F.size("_lines").cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )

