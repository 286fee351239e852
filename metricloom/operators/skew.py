"""Joins and ranks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# At most this many of the largest keys travel by broadcast. A key beyond them
# holds less than 1/1024 of the rows, which an ordinary shuffle takes.
HOT_KEYS = 1024
# Keys below this size are never worth a broadcast.
HOT_ROWS = 10_000


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    values: list[str],
    size: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which is unique on the text column ``key``.

    ``size`` is a column of ``lookup`` with the number of rows behind a key. Rows of the
    largest keys (at most ``HOT_KEYS``, so the broadcast is bounded) are joined where they
    are, without a shuffle; all others, none of which has a large key, by a shuffle.
    """
    slim = lookup.select(F.col(key).alias("_key"), F.struct(*values).alias("_found"), F.col(size).alias("_size"))
    hot = F.broadcast(slim.where(F.col("_size") >= hot_rows).orderBy(F.desc("_size"), "_key").limit(HOT_KEYS))
    same = F.col(key) == F.col("_key")
    warm = rows.join(hot, same)
    cold = rows.join(hot.select("_key"), same, "left_anti").join(slim, same, "left")
    both = warm.unionByName(cold)
    return both.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """First row of each key. The rank limit runs before the shuffle, so a hot key
    sends one row per task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def rank_rounded(rows: DataFrame, group: list[str], score: str, name: str = "rank") -> DataFrame:
    """Competition rank by descending ``score`` within ``group``; nulls rank as zero.

    Scores are rounded to one decimal within a fixed range, so a group has few
    distinct ones: they are counted first, ranked as counts, and joined back.
    """
    keyed = rows.withColumn("_score", F.coalesce(F.col(score), F.lit(0.0)))
    counts = keyed.groupBy(*group, "_score").agg(F.count(F.lit(1)).alias("_n"))
    better = (
        Window.partitionBy(*group)
        .orderBy(F.desc("_score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = counts.withColumn(
        name, F.coalesce(F.sum("_n").over(better), F.lit(0)) + F.lit(1)
    )
    as_key = F.to_json(F.struct(*group, "_score"))
    return attach(
        keyed.withColumn("_rank_key", as_key),
        ranks.withColumn("_rank_key", as_key),
        "_rank_key",
        [name],
        "_n",
    ).drop("_rank_key", "_score")


def upper_median(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Middle value per group, the upper one of an even count.

    Values are counted, then narrowed in two steps: first to a bucket that keeps
    the eight leading binary digits, then within that bucket. No step holds more
    than the distinct buckets of a group or the distinct values of one bucket.
    """
    counts = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("bigint").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    digits = F.greatest(F.length(F.bin("_v")) - 8, F.lit(0))
    counts = counts.withColumn("_shift", digits).withColumn(
        "_bucket", F.expr("shiftright(_v, _shift)")
    )
    buckets = counts.groupBy(*group, "_shift", "_bucket").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_shift", "_bucket").rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        buckets.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_half", F.floor(F.sum("_n").over(whole) / 2))
        .where("_upto > _half AND _upto - _n <= _half")
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .select(*group, "_shift", "_bucket", "_before", "_half")
    )
    inside = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(middle, [*group, "_shift", "_bucket"])
        .withColumn("_at", F.col("_before") + F.sum("_n").over(inside))
        .where("_at > _half AND _at - _n <= _half")
        .select(*group, F.col("_v").cast("double").alias(name))
    )
