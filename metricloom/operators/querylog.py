"""Logs of exploration runs and the union of their proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.text import normalise_sql, truncate
from metricloom.operators.skew import keep_first

# Lengths of the shortened texts.
SHORT_SQL = 120
SHORT_RESULT = 800


def dedup_queries(log: DataFrame) -> DataFrame:
    """First occurrence of each statement over all runs; whitespace around it is
    ignored, case is not."""
    trimmed = F.regexp_replace("sql", r"(?U)^\s+|\s+$", "")
    keyed = log.withColumn("_sql", trimmed)
    return keep_first(keyed, ["_sql"], ["run", "pos"]).drop("_sql")


def shorten(log: DataFrame) -> DataFrame:
    """Log rows with their label, whole statement, and result cut for display."""
    label = F.coalesce(F.nullif("plain_language", F.lit("")), F.nullif("reason", F.lit("")), F.lit("Query"))
    return log.select(
        "run",
        "pos",
        label.alias("label"),
        "sql",
        truncate(F.col("result"), SHORT_RESULT, "\n... (truncated)").alias("result"),
    )


def shorten_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with their statement on one line, cut for display."""
    line = F.replace("sql", F.lit("\n"), F.lit(" "))
    return proposals.withColumn("sql", truncate(line, SHORT_SQL, "…"))


def log_totals(log: DataFrame, deduped: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Queries and first-seen queries per run, and its proposed metrics where given."""
    totals = (
        log.groupBy("run")
        .agg(F.count(F.lit(1)).alias("n_queries"))
        .join(deduped.groupBy("run").agg(F.count(F.lit(1)).alias("n_unique")), "run", "left")
    )
    if proposals is not None:
        counted = proposals.groupBy("run").agg(F.count(F.lit(1)).alias("n_proposed"))
        totals = totals.join(counted, "run", "left")
    return totals.fillna(0)


def union_proposals(proposals: DataFrame) -> DataFrame:
    """All proposed metrics over all runs: a row for each name and normalised statement,
    as first proposed, with the runs that proposed it."""
    form = normalise_sql(F.col("sql"))
    first = F.min(F.struct("run", "pos", "name", "sql")).alias("first")
    grouped = proposals.groupBy(F.col("name").alias("_name"), form.alias("_form")).agg(
        first, F.array_sort(F.collect_set("run")).alias("runs")
    )
    return grouped.select("first.*", "runs")
