"""Repair of evaluated catalogues: patched ranges, routing, actions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.periods import snap_to_period
from metricloom.functions.text import quoted_name, quoted_text
from metricloom.operators.evaluate import is_evaluator_crash
from metricloom.sources.tables import run_sql

# Codes that are repaired without looking at the statement.
PATCHED_DIRECTLY = ("date_mismatch", "period_boundary")
# Fixed value: most values of a category column that is split into metrics.
MAX_SPLIT = 5
# Types whose values name categories.
CATEGORY_TYPES = (T.StringType, T.VarcharType, T.CharType, T.BooleanType, T.DateType)


def _codes() -> Column:
    return F.split(F.coalesce("error", F.lit("")), ", ")


def patched_ranges(results: DataFrame) -> DataFrame:
    """Results that get a new declared range: the measured one after a mismatch, then
    moved to period starts where the boundary was wrong."""
    codes = _codes()
    take = (
        F.array_contains(codes, "date_mismatch")
        & (F.col("actual_start") != "")
        & (F.col("actual_end") != "")
    )
    snap = F.array_contains(codes, "period_boundary")

    def bound(side: str) -> Column:
        picked = F.when(take, F.col(f"actual_{side}")).otherwise(F.col(f"declared_{side}"))
        return F.when(snap, snap_to_period(picked, F.col("granularity"))).otherwise(picked)

    return (
        results.where(F.col("status").isin("WARN", "FAIL"))
        .withColumn("new_start", bound("start"))
        .withColumn("new_end", bound("end"))
        .where((F.col("new_start") != F.col("declared_start")) | (F.col("new_end") != F.col("declared_end")))
    )


def apply_patches(metrics: DataFrame, patches: DataFrame) -> DataFrame:
    """Metrics with their patched ranges; the rest unchanged."""
    new = patches.select(
        "catalogue_id",
        "name",
        F.struct(F.col("new_start").alias("start"), F.col("new_end").alias("end")).alias("new_range"),
    ).dropDuplicates(["catalogue_id", "name"])
    return (
        metrics.join(new, ["catalogue_id", "name"], "left")
        .withColumn("time_range", F.coalesce("new_range", "time_range"))
        .drop("new_range")
        .select(*metrics.columns)
    )


def needs_investigation(metric_results: DataFrame, fact_results: DataFrame) -> DataFrame:
    """Issues that remain after direct patching. Evaluator crashes are left out, and
    so are metrics whose only codes are patched directly."""
    bad = F.col("status").isin("WARN", "FAIL") & ~is_evaluator_crash()
    patched = F.array(*[F.lit(c) for c in PATCHED_DIRECTLY])
    metrics = metric_results.where(bad & (F.size(F.array_except(_codes(), patched)) > 0))
    facts = fact_results.where(bad)
    columns = ["catalogue_id", "pos", "name", "status", "error", "n_rows"]
    return (
        metrics.select(F.lit("METRIC").alias("kind"), *columns, "value_min", "value_max")
        .unionByName(
            facts.select(F.lit("FACT").alias("kind"), *columns), allowMissingColumns=True
        )
    )


def issue_details(issues: DataFrame) -> DataFrame:
    """One line per issue with what the evaluation measured."""
    constant = F.col("value_min") == F.col("value_max")
    rows = F.col("n_rows").cast("string")
    detail = (
        F.when(F.col("n_rows") == 0, "0 rows returned")
        .when(constant, F.concat(rows, F.lit(" row(s), all values = "), F.col("value_min").cast("string")))
        .otherwise(F.concat(rows, F.lit(" row(s) returned")))
    )
    return issues.withColumn("detail", detail)


def refine_actions(results: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """What to do with each metric: keep, annotate, split, move to facts, remove, report.

    ``categories`` gives (catalogue_id, name, n_categories) for statements with more
    than two columns.
    """
    codes = _codes()
    rows = results
    if categories is None:
        rows = rows.withColumn("n_categories", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(categories, ["catalogue_id", "name"], "left")

    def has(code: str) -> Column:
        return F.array_contains(codes, code)

    action = (
        F.when(F.col("error").startswith("Only "), "move_to_facts")
        .when(is_evaluator_crash(), "keep")
        .when(F.col("status") == "FAIL", "report")
        .when(has("zero_rows"), "remove")
        .when(has("extra_cols") & F.col("n_categories").between(1, MAX_SPLIT), "split")
        .when(has("extra_cols"), "move_to_facts")
        .when(has("high_nulls"), "report")
        .when(has("sparse") | has("constant_values"), "annotate")
        .otherwise("keep")
    )
    note = (
        F.when(action == "remove", F.concat(F.lit("Metric removed, no data: "), "name"))
        .when(
            (action == "annotate") & has("constant_values"),
            F.concat(F.lit("Same value in all "), F.col("n_rows").cast("string"), F.lit(" rows.")),
        )
        .when(action == "annotate", F.concat(F.lit("Only "), F.col("n_rows").cast("string"), F.lit(" rows.")))
        .otherwise("")
    )
    return rows.withColumn("action", action).withColumn("note", note)


def split_columns(df: DataFrame) -> tuple[int, int] | None:
    """Places of the category and of the value in a statement (period, ...): the first column
    after the period that is no number, and the first that is one. None if either is missing:
    a measure is nothing to split by, and a text nothing to measure."""
    rest = list(enumerate(df.schema.fields))[1:]
    numbers = [i for i, f in rest if isinstance(f.dataType, T.NumericType)]
    others = [i for i, f in rest if type(f.dataType) in CATEGORY_TYPES]
    return (others[0], numbers[0]) if others and numbers else None


def _by_place(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ...: a statement may give one name to several."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def category_count(spark: SparkSession, sql: str) -> DataFrame:
    """Distinct non-null values of the category column of a statement; 0 without one."""
    df = run_sql(spark, sql)
    places = split_columns(df)
    if places is None:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n_categories"))
    return _by_place(df).agg(F.count_distinct(f"c{places[0]}").alias("n_categories"))


def split_by_category(spark: SparkSession, metric: dict) -> list[dict]:
    """One two-column metric per value of the category column, or none when there are
    more than ``MAX_SPLIT`` values, or no such column."""
    df = run_sql(spark, metric["sql"])
    places = split_columns(df)
    if places is None:
        return []
    category, value = (f"c{i}" for i in places)
    distinct = _by_place(df).select(F.col(category).cast("string").alias("v")).distinct().where("v IS NOT NULL")
    values = sorted(r["v"] for r in distinct.limit(MAX_SPLIT + 1).collect())
    if len(values) > MAX_SPLIT:
        return []
    body = metric["sql"].strip().rstrip(";")
    names = ", ".join(f"c{i}" for i in range(len(df.columns)))
    period, number = (quoted_name(df.columns[i]) for i in (0, places[1]))
    return [
        {
            **metric,
            "name": f"{metric['name']} ({v})",
            "sql": f"SELECT c0 AS {period}, {value} AS {number} FROM (\n{body}\n) AS t({names}) "
            f"WHERE CAST({category} AS STRING) = {quoted_text(v)}",
        }
        for v in values
    ]


def as_facts(metrics: DataFrame) -> DataFrame:
    """Metrics re-tagged as facts; time range, unit and granularity do not apply."""
    return metrics.select(
        "catalogue_id", "pos", "name", "description", "sql", "tables_used", "agent_notes", "group"
    )


def choose_refined(
    refined_metrics: DataFrame, refined_facts: DataFrame, patched_metrics: DataFrame, patched_facts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Per catalogue the refined entries, unless refinement left it without any."""
    alive = (
        refined_metrics.select("catalogue_id").union(refined_facts.select("catalogue_id")).distinct()
    )

    def pick(refined: DataFrame, patched: DataFrame) -> DataFrame:
        fallback = patched.join(alive, "catalogue_id", "left_anti")
        return refined.unionByName(fallback.select(*refined.columns))

    return pick(refined_metrics, patched_metrics), pick(refined_facts, patched_facts)


def restore_tables(refined: DataFrame, original: DataFrame) -> DataFrame:
    """Refined table summaries with the original row counts and notes where known."""
    known = original.select(
        "catalogue_id",
        "name",
        F.col("row_count").alias("orig_rows"),
        F.col("data_quality_notes").alias("orig_notes"),
        F.lit(True).alias("known"),
    )
    return (
        refined.join(known, ["catalogue_id", "name"], "left")
        .withColumn("row_count", F.when(F.col("known"), F.col("orig_rows")).otherwise(F.col("row_count")))
        .withColumn(
            "data_quality_notes",
            F.when(F.col("known"), F.col("orig_notes")).otherwise(F.col("data_quality_notes")),
        )
        .select(*refined.columns)
    )


def name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric names removed and added between two versions of a catalogue."""
    keys = ["catalogue_id", "name"]
    old, new = before.select(*keys), after.select(*keys)
    removed = old.subtract(new).withColumn("change", F.lit("removed"))
    added = new.subtract(old).withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def refinement_summary(
    before: DataFrame, after: DataFrame, patches: DataFrame, issues: DataFrame
) -> DataFrame:
    """Counts per catalogue: metrics before and after, removed, added, patched, sent on,
    and whether fewer than half were kept."""

    def counted(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        total = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.groupBy("catalogue_id").agg(total.alias(name))

    changes = name_changes(before, after)
    parts = [
        counted(after, "n_after"),
        counted(changes, "n_removed", F.col("change") == "removed"),
        counted(changes, "n_added", F.col("change") == "added"),
        counted(patches, "n_patched"),
        counted(issues, "n_issues"),
    ]
    rows = counted(before, "n_before")
    for part in parts:
        rows = rows.join(part, "catalogue_id", "left")
    rows = rows.fillna(0)
    return rows.withColumn(
        "lost_half", (F.col("n_before") > 0) & (F.col("n_after") < F.col("n_before") * 0.5)
    )
