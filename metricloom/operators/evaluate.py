"""Evaluation of metrics and facts on the full data.

A metric's rows are reduced to one row of statistics inside Spark; the rules then
are column expressions over those statistics. Two ways lead there: stored SQL
texts, one statement each, and a family of metrics that lies in one long table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.coerce import date_text, reads_as_date, to_value
from metricloom.functions.periods import month_prefix, on_boundary
from metricloom.functions.text import normalise_sql
from metricloom.operators.shared_scans import Form, normal_form, passes, statistics
from metricloom.operators.skew import attach
from metricloom.schemas import SERIES_STATS
from metricloom.session import pin
from metricloom.sources.tables import run_sql

# Thresholds of the warning codes.
MAX_NULL_RATE = 0.10
MIN_ROWS = 3
MAX_BAD_DATE_RATE = 0.05

# Statements running at the same time.
CONCURRENT = 8
# Statements whose texts and rows the driver holds at a time.
BATCH = 512

T = TypeVar("T")

NO_SQL = "No SQL in catalogue entry"


def series_columns(df: DataFrame) -> DataFrame:
    """First two columns of a result, whatever their names, as (ord, date, value,
    date_ok) in result order."""
    first, second = (f.dataType for f in df.schema.fields[:2])
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(
        F.monotonically_increasing_id().alias("ord"),
        date_text(F.col("c0"), first).alias("date"),
        to_value(F.col("c1"), second).alias("value"),
        reads_as_date(F.col("c0"), first).alias("date_ok"),
    )


def _statistics() -> list[Column]:
    valid_ord = F.when(F.col("value").isNotNull(), F.col("ord"))
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count("value").alias("valid_rows"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.coalesce(F.min_by("date", valid_ord), F.lit("")).alias("actual_start"),
        F.coalesce(F.max_by("date", valid_ord), F.lit("")).alias("actual_end"),
        F.count_if(~F.col("date_ok")).alias("bad_dates"),
    ]


def _row(sql: str, ok: bool, error: str = "", names: list[str] | None = None, stats=None) -> tuple:
    """One row of :data:`SERIES_STATS`."""
    names = names or []
    known = {"sql": sql, "sql_ok": ok, "sql_error": error, "n_cols": len(names), "col_names": names}
    known |= {} if stats is None else stats if isinstance(stats, dict) else stats.asDict()
    return tuple(known.get(f.name) for f in SERIES_STATS.fields)


# Signs of a failure of the cluster, which says nothing about a statement.
LOST = (
    "ExecutorLostFailure", "FetchFailed", "No space left on device", "OutOfMemoryError",
    "SparkContext was shut down", "stopped SparkContext", "Connection refused", "heartbeat",
)


def run_twice(job: Callable[[], T]) -> T:
    """Result of a job. Where the cluster failed it, it is tried once more and then fails
    for good; an error of the statement itself is raised at once."""
    try:
        return job()
    except Exception as error:  # noqa: BLE001 - a task failure arrives as a JVM error
        if not any(sign in str(error) for sign in LOST):
            raise
    return job()


def _own_error(error: Exception) -> str:
    """Text of a statement's error; a failure of the cluster goes on upwards."""
    if any(sign in str(error) for sign in LOST):
        raise error
    return str(error)


def _measure(spark: SparkSession, shape_only: bool, sql: str) -> tuple:
    """Statistics of one statement, reduced to one row inside Spark. Errors of the
    statement itself show at analysis without a job, or when it runs; where only the
    reduction fails, the statement alone is run to tell the two apart."""
    if not sql.strip():
        return _row(sql, False, NO_SQL)
    try:
        df = run_sql(spark, sql)
        names = df.columns
        if shape_only or len(names) < 2:
            stats = df.agg(F.count(F.lit(1)).alias("total_rows"))
        else:
            stats = series_columns(df).agg(*_statistics())
    except PySparkException as error:
        return _row(sql, False, _own_error(error))
    try:
        return _row(sql, True, "", names, run_twice(stats.first))
    except Exception as error:  # noqa: BLE001 - a task failure arrives as a JVM error
        crash = _own_error(error)
        try:
            run_twice(df.write.format("noop").mode("overwrite").save)
        except Exception as own:  # noqa: BLE001
            return _row(sql, False, _own_error(own))
        return _row(sql, True, f"eval error: {crash}", names)


def _measure_pass(spark: SparkSession, forms: list[Form]) -> list[tuple]:
    """Statistics of statements that share a scan. Where the pass fails for one of them, each
    runs alone, so that no error is charged to another."""
    try:
        found = run_twice(partial(statistics, spark, forms))
    except Exception as error:  # noqa: BLE001 - a task failure arrives as a JVM error
        _own_error(error)
        return [_measure(spark, False, f.sql) for f in forms]
    return [_row(f.sql, True, "", list(f.names), found[f.sql]) for f in forms]


def _shared(spark: SparkSession, sqls: list[str], pool: ThreadPoolExecutor) -> list[Callable[[], list[tuple]]]:
    """Work on a batch of statements: passes over those that fit together, the rest singly."""
    forms = dict(zip(sqls, pool.map(partial(normal_form, spark), sqls), strict=True))
    together = passes(f for f in forms.values() if f is not None)
    shared = {f.sql for g in together if len(g) > 1 for f in g}
    jobs = [partial(_measure_pass, spark, g) for g in together if len(g) > 1]
    return jobs + [partial(_alone, partial(_measure, spark, False), q) for q in sqls if q not in shared]


def _alone(job: Callable[[str], tuple], sql: str) -> list[tuple]:
    return [job(sql)]


def each_statement(
    spark: SparkSession,
    entries: DataFrame,
    job: Callable[[str], tuple],
    schema,
    width: int = CONCURRENT,
    share: bool = False,
) -> DataFrame:
    """Rows of ``job`` for each distinct statement of ``entries``.

    Statements run a few at a time as jobs of their own, so one that fails disturbs no
    other; with ``share``, those of one normal form share a scan (:mod:`shared_scans`). The
    driver holds one batch of texts and their rows; a full batch is written out before the
    next begins.
    """
    texts = entries.select(F.coalesce("sql", F.lit("")).alias("sql")).distinct()
    sqls = (r["sql"] for r in texts.toLocalIterator())
    done = None
    with ThreadPoolExecutor(width) as pool:
        while batch := list(islice(sqls, BATCH)):
            work = _shared(spark, batch, pool) if share else [partial(_alone, job, q) for q in batch]
            found = [row for rows in pool.map(lambda one: one(), work) for row in rows]
            rows = spark.createDataFrame(found, schema)
            if done is not None or len(batch) == BATCH:
                rows = pin(rows)
            done = rows if done is None else done.unionByName(rows)
    return done if done is not None else spark.createDataFrame([], schema)


def measure_sql(
    spark: SparkSession, entries: DataFrame, shape_only: bool = False, width: int = CONCURRENT
) -> DataFrame:
    """Statistics per distinct statement of ``entries``; each runs once however many
    entries share it, and series of one table and period share a scan. The driver sees
    statement texts and one row each, by the batch.
    """
    job = partial(_measure, spark, shape_only)
    return each_statement(spark, entries, job, SERIES_STATS, width, share=not shape_only)


def apply_rules(measured: DataFrame) -> DataFrame:
    """Metric results from entry fields and statistics: codes in fixed order, then status.

    Expects name, confidence, granularity, unit, declared_start, declared_end and the
    columns of :data:`SERIES_STATS`; other columns pass through.
    """
    empty = F.lit("")
    prepared = (
        measured.withColumn("declared_start", F.coalesce("declared_start", empty))
        .withColumn("declared_end", F.coalesce("declared_end", empty))
        .withColumn("n_cols", F.coalesce("n_cols", F.lit(0)))
        .withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
        .withColumn("shaped", F.col("sql_ok") & (F.col("sql_error") == "") & (F.col("n_cols") >= 2))
        .withColumn("analysed", F.col("shaped") & (F.col("total_rows") > 0))
    )
    analysed = F.col("analysed")
    start, end = month_prefix(F.col("declared_start")), month_prefix(F.col("declared_end"))
    in_range = ((start == "") | (month_prefix(F.col("actual_start")) >= start)) & (
        (end == "") | (month_prefix(F.col("actual_end")) <= end)
    )
    aligned = on_boundary(F.col("declared_start"), F.col("granularity")) & on_boundary(
        F.col("declared_end"), F.col("granularity")
    )
    dates_ok = F.col("bad_dates") / F.col("total_rows") <= MAX_BAD_DATE_RATE
    facts = (
        prepared.withColumn(
            "null_rate",
            F.when(
                analysed, (F.col("total_rows") - F.col("valid_rows")) / F.col("total_rows")
            ).otherwise(0.0),
        )
        .withColumn("n_rows", F.when(analysed, F.col("valid_rows")).otherwise(F.col("total_rows")))
        .withColumn("actual_start", F.when(analysed, F.col("actual_start")).otherwise(empty))
        .withColumn("actual_end", F.when(analysed, F.col("actual_end")).otherwise(empty))
        .withColumn("value_min", F.when(analysed, F.col("value_min")))
        .withColumn("value_max", F.when(analysed, F.col("value_max")))
        .withColumn("date_range_ok", analysed & in_range)
        .withColumn("period_boundary_ok", ~analysed | F.coalesce(aligned, F.lit(True)))
        .withColumn("date_col_ok", ~analysed | F.coalesce(dates_ok, F.lit(True)))
    )

    def code(name: str, when: Column) -> Column:
        return F.when(when, name)

    codes = F.array_compact(
        F.array(
            code("high_nulls", F.col("null_rate") > MAX_NULL_RATE),
            code("sparse", F.col("n_rows") < MIN_ROWS),
            code("date_mismatch", ~F.col("date_range_ok")),
            code("extra_cols", F.col("n_cols") != 2),
            code("period_boundary", ~F.col("period_boundary_ok")),
            code("non_date_col", ~F.col("date_col_ok")),
            code(
                "constant_values", (F.col("n_rows") > 1) & (F.col("value_min") == F.col("value_max"))
            ),
        )
    )
    error = (
        F.when(F.col("sql_error") != "", F.col("sql_error"))
        .when(
            F.col("n_cols") < 2,
            F.concat(
                F.lit("Only "), F.col("n_cols").cast("string"), F.lit(" column(s) returned; expected 2")
            ),
        )
        .when(F.col("total_rows") == 0, "zero_rows")
        .otherwise(F.concat_ws(", ", codes))
    )
    status = F.when(~F.col("shaped"), "FAIL").when(F.col("error") == "", "PASS").otherwise("WARN")
    return (
        facts.withColumn("error", error)
        .withColumn("status", status)
        .withColumn("duplicate_of", empty)
        .drop("shaped", "analysed", "sql_error", "total_rows", "valid_rows", "bad_dates")
    )


def _entry_fields(metrics: DataFrame) -> DataFrame:
    unknown = F.lit("?")
    return metrics.select(
        "catalogue_id",
        "pos",
        "name",
        F.coalesce("sql", F.lit("")).alias("sql"),
        F.coalesce("confidence", unknown).alias("confidence"),
        F.coalesce("granularity", unknown).alias("granularity"),
        F.coalesce("unit", unknown).alias("unit"),
        F.col("time_range.start").alias("declared_start"),
        F.col("time_range.end").alias("declared_end"),
    )


def evaluate_metrics(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """Metric results of catalogue entries (:data:`METRIC_ROW`), before duplicates are marked."""
    stats = measure_sql(spark, metrics)
    return apply_rules(_entry_fields(metrics).join(stats, "sql")).drop("sql")


def evaluate_facts(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Fact results of catalogue entries (:data:`FACT_ROW`)."""
    stats = measure_sql(spark, facts, shape_only=True)
    entries = facts.select("catalogue_id", "pos", "name", F.coalesce("sql", F.lit("")).alias("sql"))
    joined = entries.join(stats, "sql")
    n_rows, n_cols = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_rows", "n_cols"))
    error = (
        F.when(F.col("sql_error") != "", F.col("sql_error"))
        .when(n_cols == 0, "Query returned no columns")
        .when(n_rows == 0, "zero_rows")
        .otherwise("")
    )
    status = F.when(error == "", "PASS").when(error == "zero_rows", "WARN").otherwise("FAIL")
    return joined.select(
        "catalogue_id",
        "pos",
        "name",
        "sql_ok",
        error.alias("error"),
        n_cols.alias("n_cols"),
        n_rows.alias("n_rows"),
        status.alias("status"),
    )


def family_statistics(series: DataFrame, key: str) -> DataFrame:
    """Statistics of many metrics at once, from rows (key, period timestamp, value).

    Periods are in date order within a metric, so its first and last valid rows are
    the smallest and largest valid period; all buffers are numbers and combine
    before the shuffle, whatever the size of a metric.
    """
    valid_period = F.when(F.col("value").isNotNull(), F.col("period"))
    return series.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("value").alias("valid_rows"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.min(valid_period).alias("first_period"),
        F.max(valid_period).alias("last_period"),
        F.count_if(F.col("period").isNull()).alias("bad_dates"),
    )


def evaluate_family(entries: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Metric results of a family of metrics whose series lie in one long table.

    ``entries`` carries the entry fields (see :func:`apply_rules`), ``key`` and the
    shape of the statement (sql_ok, sql_error, n_cols). An entry without rows has an
    empty series.
    """
    stats = family_statistics(series, key)
    day = "yyyy-MM-dd"
    joined = entries.join(stats, key, "left").withColumns(
        {
            "actual_start": F.coalesce(F.date_format("first_period", day), F.lit("")),
            "actual_end": F.coalesce(F.date_format("last_period", day), F.lit("")),
        }
    )
    return apply_rules(joined).drop("first_period", "last_period")


def duplicate_sql(metrics: DataFrame) -> DataFrame:
    """Later metrics of a catalogue whose statement equals an earlier one, with the
    name of the first. Blank statements are ignored."""
    keyed = metrics.where(F.coalesce("sql", F.lit("")) != "").select(
        "catalogue_id",
        "pos",
        "name",
        F.sha2(F.concat_ws("\u0000", "catalogue_id", normalise_sql(F.col("sql"))), 256).alias("k"),
    )
    firsts = (
        keyed.groupBy("k")
        .agg(F.min(F.struct("pos", "name")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("k", "n", F.col("first.pos").alias("first_pos"), F.col("first.name").alias("duplicate_of"))
    )
    return (
        attach(keyed, firsts, "k", ["first_pos", "duplicate_of"], "n")
        .where("pos > first_pos")
        .select("catalogue_id", "pos", "name", "duplicate_of")
    )


def mark_duplicates(results: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Stamp ``duplicate_sql`` on results named in ``duplicates``: a PASS becomes WARN,
    other states stay."""
    # A repeated name takes the mapping of its last occurrence.
    by_name = duplicates.groupBy("catalogue_id", "name").agg(
        F.max_by("duplicate_of", "pos").alias("first_name")
    )
    found = F.col("first_name").isNotNull()
    kept = F.filter(F.split("error", ", "), lambda c: (c != "") & (c != "duplicate_sql"))
    stamped = F.concat_ws(", ", F.array_append(kept, F.lit("duplicate_sql")))
    return (
        results.join(by_name, ["catalogue_id", "name"], "left")
        .withColumn("duplicate_of", F.when(found, F.col("first_name")).otherwise(F.col("duplicate_of")))
        .withColumn("error", F.when(found, stamped).otherwise(F.col("error")))
        .withColumn(
            "status", F.when(found & (F.col("status") == "PASS"), "WARN").otherwise(F.col("status"))
        )
        .drop("first_name")
    )


def evaluate_catalogue(
    spark: SparkSession, metrics: DataFrame, facts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Metric results with duplicates marked, and fact results."""
    results = mark_duplicates(evaluate_metrics(spark, metrics), duplicate_sql(metrics))
    return results, evaluate_facts(spark, facts)


def warning_codes(results: DataFrame) -> DataFrame:
    """Distinct codes among the warnings of each catalogue."""
    return (
        results.where("status = 'WARN' AND error != ''")
        .select("catalogue_id", F.explode(F.split("error", ", ")).alias("code"))
        .groupBy("catalogue_id", "code")
        .agg(F.count(F.lit(1)).alias("n_results"))
    )


def is_evaluator_crash() -> Column:
    """The statement ran, but its analysis failed."""
    return F.col("sql_ok") & F.coalesce(F.col("error").startswith("eval error:"), F.lit(False))
