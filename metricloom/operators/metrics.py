"""Builders of metrics and facts.

Every metric comes back as (date, value) with one row per period; grouping is by
the truncated timestamp and the period text is made after grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.periods import period_start, period_text


def _by_period(df: DataFrame, ts: str, granularity: str, value: Column, where: Column | None = None):
    rows = df if where is None else df.where(where)
    return rows.groupBy(period_start(F.col(ts), granularity).alias("period")).agg(value.alias("value"))


def _series(grouped: DataFrame, granularity: str) -> DataFrame:
    return grouped.where(F.col("period").isNotNull()).select(
        period_text(F.col("period"), granularity).alias("date"), "value"
    )


def count_metric(df: DataFrame, ts: str, granularity: str, where: Column | None = None) -> DataFrame:
    """Rows per period."""
    return _series(_by_period(df, ts, granularity, F.count(F.lit(1)), where), granularity)


def sum_metric(
    df: DataFrame, ts: str, value: Column, granularity: str, where: Column | None = None
) -> DataFrame:
    """Total per period."""
    return _series(_by_period(df, ts, granularity, F.sum(value), where), granularity)


def average_metric(
    df: DataFrame, ts: str, value: Column, granularity: str, where: Column | None = None
) -> DataFrame:
    """Mean per period."""
    return _series(_by_period(df, ts, granularity, F.avg(value), where), granularity)


def rate_metric(
    df: DataFrame, ts: str, condition: Column, granularity: str, base: Column | None = None
) -> DataFrame:
    """Share of rows that meet ``condition``, out of the rows that meet ``base``."""
    total = F.count(F.lit(1)) if base is None else F.count_if(base)
    hits = condition if base is None else condition & base
    return _series(_by_period(df, ts, granularity, F.try_divide(F.count_if(hits), total)), granularity)


def cumulative_metric(df: DataFrame, ts: str, granularity: str, value: Column | None = None) -> DataFrame:
    """Running total at the end of each period. The running sum only sees one row per
    period, so its single ordered task is bounded by the calendar."""
    flow = F.count(F.lit(1)) if value is None else F.sum(value)
    grouped = _by_period(df, ts, granularity, flow).where(F.col("period").isNotNull())
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _series(grouped.withColumn("value", F.sum("value").over(upto)), granularity)


def tick_metric(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """One row per raw record."""
    return df.select(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), value.alias("value"))


def split_metric(
    df: DataFrame,
    ts: str,
    dimension: str,
    base_name: str,
    granularity: str,
    value: Column | None = None,
) -> DataFrame:
    """One metric per value of ``dimension``, all in one pass: (name, date, value)."""
    flow = F.count(F.lit(1)) if value is None else value
    grouped = (
        df.where(F.col(dimension).isNotNull())
        .groupBy(dimension, period_start(F.col(ts), granularity).alias("period"))
        .agg(flow.alias("value"))
    )
    name = F.concat(F.lit(f"{base_name} ("), F.col(dimension).cast("string"), F.lit(")"))
    return grouped.where(F.col("period").isNotNull()).select(
        name.alias("name"), period_text(F.col("period"), granularity).alias("date"), "value"
    )


def cross_table_metric(
    child: DataFrame,
    parent: DataFrame,
    child_key: str,
    parent_key: str,
    ts: str,
    granularity: str,
    value: Column | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Total (or count) of ``child`` per period across a foreign key.

    The child is summed per key before the join, so a frequent key meets the parent
    as few rows. ``ts`` may lie on either side; ``by`` names parent columns to keep.
    """
    flow = F.count(F.lit(1)) if value is None else F.sum(value)
    by = by or []
    on_child = ts in child.columns
    keys = [F.col(child_key).alias("_key")]
    if on_child:
        keys.append(period_start(F.col(ts), granularity).alias("period"))
    summed = child.where(F.col(child_key).isNotNull()).groupBy(*keys).agg(flow.alias("_flow"))
    cols = [F.col(parent_key).alias("_key"), *by]
    if not on_child:
        cols.append(period_start(F.col(ts), granularity).alias("period"))
    joined = summed.join(parent.select(*cols), "_key")
    grouped = joined.groupBy(*by, "period").agg(F.sum("_flow").alias("value"))
    return grouped.where(F.col("period").isNotNull()).select(
        *by, period_text(F.col("period"), granularity).alias("date"), "value"
    )


def lookup_fact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Reference table: distinct rows of ``columns``."""
    return df.select(*columns).distinct()


def snapshot_fact(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Current state as a single row."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()])


def breakdown_fact(
    df: DataFrame, ts: str, dimensions: list[str], granularity: str, **aggregates: Column
) -> DataFrame:
    """Full breakdown by period and dimensions."""
    grouped = df.groupBy(period_start(F.col(ts), granularity).alias("period"), *dimensions).agg(
        *[c.alias(n) for n, c in aggregates.items()]
    )
    return grouped.withColumn("period", period_text(F.col("period"), granularity))
