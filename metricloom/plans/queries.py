"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

import re
import tempfile
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import coerce, json_text, periods, text
from metricloom.operators import (
    assemble, broker, coverage, decision, dimensions, evaluate, gate, keys, lineage, metrics, profile, propose, querylog,
    refine, scoring, similar_names, sketches, usage, workflow,
)
from metricloom.plans import inputs
from metricloom.schemas import FACT_ROW, METRIC, METRIC_ROW, PRICE_BOOK
from metricloom.session import pin, until_exit
from metricloom.sources import catalogues, tables
from metricloom.streaming import calls as call_stream
from metricloom.streaming import windows as stream_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_MEASURED = ["null_rate", "value_min", "value_max"]


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _open(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    found = tables.open_folder(spark, folder, names=list(names) or inputs.TABLES)
    tables.register(found)
    return found


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _open(spark, folder, name)[name]


def _input(spark: SparkSession, folder: str, sql: str, spread: str | None = None) -> DataFrame:
    """Rows of a derived input; only the tables its text names are opened. The rows of the
    table ``spread`` are dealt to all cores while they are narrow, for inputs that are long."""
    found = _open(spark, folder, *[t for t in inputs.TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)])
    if spread is not None:
        tables.register({spread: found[spread].repartition(_tasks(spark), inputs.PRIMARY_KEYS[spread][0])})
    return spark.sql(sql)


def _tasks(spark: SparkSession) -> int:
    """Partitions for few bytes with much work: a fixed count, which keeps all cores busy."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _profile(spark: SparkSession, folder: str, *names: str, **parts) -> DataFrame:
    return profile.profile_columns(spark, _open(spark, folder, *names), inputs.PRIMARY_KEYS, **parts)


def _snapshot(spark: SparkSession, folder: str, **options) -> profile.Snapshot:
    return profile.introspect(
        spark, _open(spark, folder), inputs.PRIMARY_KEYS, inputs.FOREIGN_KEYS,
        f"parquet://reader:secret@files{folder}", "parquet", **options,
    )


def _list(column: str) -> Column:
    return F.array_join(column, ",")


def _metric_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _input(spark, folder, inputs.CUSTOMER_METRICS).select(
        "*",
        F.split("tables_csv", ",").alias("tables_used"),
        F.struct(F.col("declared_start").alias("start"), F.col("declared_end").alias("end")).alias("time_range"),
    )


def _metric_results(spark: SparkSession, folder: str, entries: DataFrame | None = None) -> DataFrame:
    """Evaluated and duplicate-marked metrics, one per customer. Most readers use them
    more than once, so they are materialised."""
    entries = entries or _metric_entries(spark, folder)
    series = _input(spark, folder, inputs.CUSTOMER_SERIES)
    fields = [
        "catalogue_id", "pos", "name", "confidence", "granularity", "unit", "declared_start",
        "declared_end", "n_cols", "sql_error", "sql_ok",
    ]
    results = evaluate.evaluate_family(entries.select(*fields), series, "pos")
    return pin(evaluate.mark_duplicates(results, evaluate.duplicate_sql(entries)))


def _fact_results(spark: SparkSession, folder: str) -> DataFrame:
    return _input(spark, folder, inputs.SUPPLIER_FACTS)


def _fact_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_results(spark, folder).select("*", F.split("tables_csv", ",").alias("tables_used"))


def _catalogues(entries: DataFrame) -> DataFrame:
    return entries.select("catalogue_id", "label", "db_stem").distinct().withColumn("run_index", F.lit(1))


def _db_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in inputs.TABLES], "table_name string")


def _foreign_keys(spark: SparkSession) -> DataFrame:
    return profile.foreign_key_rows(spark, inputs.FOREIGN_KEYS)


# --- Profiles ---------------------------------------------------------------


@_query
def profile_table_counts(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, frequencies=False)
    return columns.groupBy("table_name").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols")
    )


@_query
def profile_numeric_stats(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, frequencies=False)
    return columns.where("type_class = 'numeric'").select(
        "table_name",
        "column_name",
        "n_null",
        F.round(F.col("min").cast("double"), 4).alias("min_value"),
        F.round(F.col("max").cast("double"), 4).alias("max_value"),
    )


@_query
def profile_date_stats(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, frequencies=False)
    return columns.where("type_class = 'date'").select(
        "table_name",
        "column_name",
        "n_null",
        periods.day_prefix(F.col("min")).alias("first_day"),
        periods.day_prefix(F.col("max")).alias("last_day"),
    )


@_query
def profile_distinct(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, ranges=False, top_k=0)
    return columns.where("stat_kind = 'categorical'").select("table_name", "column_name", "n_distinct")


@_query
def profile_distinct_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts from sketches kept by file, in two goes: the second reads only what the
    first has not. They have to equal those of one go, and the exact ones within the error."""
    found = _open(spark, folder)
    paths = {t: f"{folder.rstrip('/')}/{t}.parquet" for t in found}
    grown, whole = _scratch(spark), _scratch(spark)
    half = {t: paths[t] for t in sorted(paths)[::2]}
    sketches.update(spark, half, grown)
    sketches.update(spark, paths, grown)
    sketches.update(spark, paths, whole)
    some, all_ = (sketches.estimates(spark, s, paths) for s in (grown, whole))
    exact = profile.profile_columns(spark, found, inputs.PRIMARY_KEYS, top_k=0)
    both = some.join(all_.select("table_name", "column_name", F.col("n_distinct").alias("at_once")), ["table_name", "column_name"])
    known = exact.where("stat_kind = 'categorical'").select("table_name", "column_name", F.col("n_distinct").alias("exact"))
    error = F.abs(F.col("n_distinct") - F.col("exact"))
    return both.join(known, ["table_name", "column_name"]).select(
        "table_name", "column_name", "n_rows", "n_null",
        (F.col("n_distinct") == F.col("at_once")).alias("same_at_once"),
        (error <= F.greatest(3 * sketches.ERROR * F.col("exact"), F.lit(1))).alias("within_error"),
    )


@_query
def profile_top_values(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, ranges=False)
    return columns.select("table_name", "column_name", F.posexplode("top_values").alias("rank", "v")).select(
        "table_name", "column_name", F.col("rank").cast("bigint").alias("rank"), "v.value", "v.cnt"
    )


@_query
def column_lines(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder)
    return profile.column_lines(columns).select(
        "table_name", F.col("ordinal").cast("bigint").alias("ordinal"), "line"
    )


@_query
def snapshot_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a snapshot: titles, columns, references."""
    lines = profile.snapshot_lines(_snapshot(spark, folder))
    return lines.select("table_name", "section", F.col("pos").cast("bigint").alias("pos"), "line")


@_query
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value of a dimension stands in it, looked up in the column's map."""
    columns = profile.with_counts(_snapshot(spark, folder).columns).where("n_distinct BETWEEN 1 AND 20")
    values = columns.select("table_name", "column_name", "counts", F.explode(F.map_keys("counts")).alias("value"))
    return values.select("table_name", "column_name", "value", F.element_at("counts", F.col("value")).alias("cnt"))


@_query
def schema_lines(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, frequencies=False)
    counts = columns.groupBy("table_name").agg(F.max("n_rows").alias("n_rows"))
    return tables.schema_lines(columns).join(counts, "table_name")


@_query
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = _open(spark, folder)
    sampled = tables.sample_rows(spark, found).groupBy("table_name").agg(F.count("*").alias("n_sampled"))
    return sampled.join(profile_table_counts(spark, folder), "table_name").drop("n_cols")


@_query
def sample_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled rows themselves: the first five by primary key, cell by cell."""
    found = _open(spark, folder, *inputs.SAMPLED)
    order = {t: inputs.PRIMARY_KEYS[t] for t in inputs.SAMPLED}
    rows = tables.sample_rows(spark, found, order=order)
    cells = rows.select("table_name", "pos", F.explode(F.from_json("row_json", "map<string,string>")).alias("column_name", "value"))
    known = F.create_map(
        *[x for t, cs in inputs.SAMPLED.items() for x in (F.lit(t), F.array(*map(F.lit, cs)))]
    )
    return cells.where(F.array_contains(known[F.col("table_name")], F.col("column_name")))


@_query
def table_classes(spark: SparkSession, folder: str) -> DataFrame:
    return dimensions.table_classes(_snapshot(spark, folder, frequencies=False))


@_query
def dimension_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = dimensions.dimension_manifest(_snapshot(spark, folder))
    return found.select("table_name", "column_name", "via", _list("values").alias("values"))


@_query
def time_coverage(spark: SparkSession, folder: str) -> DataFrame:
    columns = _profile(spark, folder, frequencies=False)
    return assemble.time_coverage(columns).select(
        F.col("start").alias("first_day"), F.col("end").alias("last_day")
    )


@_query
def null_and_size_notes(spark: SparkSession, folder: str) -> DataFrame:
    found = _open(spark, folder)
    found["orders"] = found["orders"].withColumns(
        {
            "o_totalprice": F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END"),
            "o_custkey": F.expr("CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END"),
            "o_orderpriority": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"),
        }
    )
    columns = profile.profile_columns(spark, found, inputs.PRIMARY_KEYS, frequencies=False)
    counts = columns.groupBy("table_name").agg(F.max("n_rows").alias("n_rows"))
    notes = assemble.null_notes(columns).select("table_name", "note")
    return notes.unionByName(assemble.size_notes(counts))


@_query
def key_check(spark: SparkSession, folder: str) -> DataFrame:
    found = _open(spark, folder)
    keys = {**inputs.PRIMARY_KEYS, "lineitem": ["l_orderkey", "l_linenumber"]}
    return tables.union_all([tables.key_check(found[t], t, cols) for t, cols in keys.items()])


@_query
def inferred_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and references that the tables themselves show."""
    found = _open(spark, folder)
    known = keys.infer_keys(spark, found)
    links = keys.infer_references(spark, found, known)
    none = F.lit("")
    own = known.select("table_name", F.array_join("columns", ",").alias("column_names"), none.alias("to_table"), none.alias("to_column"))
    return own.unionByName(
        links.select(F.col("from_table").alias("table_name"), F.col("from_col").alias("column_names"), "to_table", F.col("to_col").alias("to_column"))
    )


@_query
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    found = _open(spark, folder)
    checks = [
        tables.foreign_key_check(found[t], t, cols, found[to], to, to_cols)
        for t, cols, to, to_cols in inputs.FOREIGN_KEYS
    ]
    urgent = found["orders"].where("o_orderpriority = '1-URGENT'")
    checks.append(
        tables.foreign_key_check(
            found["lineitem"], "lineitem", ["l_orderkey"], urgent, "urgent_orders", ["o_orderkey"]
        )
    )
    return tables.union_all(checks)


# --- Metrics and facts ------------------------------------------------------


@_query
def metric_count_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.count_metric(_table(spark, folder, "orders"), "o_orderdate", "monthly")


@_query
def metric_sum_quarterly(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = metrics.sum_metric(_table(spark, folder, "lineitem"), "l_shipdate", value, "quarterly")
    return _rounded(df, 2, "value")


@_query
def metric_avg_weekly(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.average_metric(_table(spark, folder, "events"), "ts", F.col("value"), "weekly")
    return _rounded(df, 6, "value")


@_query
def metric_count_daily(spark: SparkSession, folder: str) -> DataFrame:
    where = F.col("event_type") == "purchase"
    return metrics.count_metric(_table(spark, folder, "events"), "ts", "daily", where)


@_query
def metric_sum_annual(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.sum_metric(_table(spark, folder, "orders"), "o_orderdate", F.col("o_totalprice"), "annual")
    return _rounded(df, 2, "value")


@_query
def metric_tick(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.tick_metric(_table(spark, folder, "events"), "ts", F.col("value"))


@_query
def metric_rate(spark: SparkSession, folder: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    df = metrics.rate_metric(_table(spark, folder, "lineitem"), "l_shipdate", returned, "monthly")
    return _rounded(df, 8, "value")


@_query
def metric_rate_base(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    base = F.col("event_type").isin("error", "purchase", "click")
    df = metrics.rate_metric(_table(spark, folder, "events"), "ts", failed, "daily", base)
    return _rounded(df, 8, "value")


@_query
def metric_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.cumulative_metric(_table(spark, folder, "orders"), "o_orderdate", "monthly")


@_query
def metric_cumulative_customers(spark: SparkSession, folder: str) -> DataFrame:
    firsts = (
        _table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    )
    return metrics.cumulative_metric(firsts, "first_order", "quarterly")


@_query
def metric_dimension_split(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.split_metric(
        _table(spark, folder, "orders"), "o_orderdate", "o_orderpriority", "New Orders", "monthly"
    )


@_query
def metric_cross_table(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered volume by month of order and region, across four foreign keys."""
    t = _open(spark, folder)
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    df = metrics.cross_table_metric(
        t["lineitem"], orders, "l_orderkey", "o_orderkey", "o_orderdate", "monthly",
        F.col("l_quantity"), by=["r_name"],
    )
    return _rounded(df, 2, "value")


@_query
def metric_cross_table_child_date(spark: SparkSession, folder: str) -> DataFrame:
    t = _open(spark, folder)
    return metrics.cross_table_metric(
        t["lineitem"], t["supplier"], "l_suppkey", "s_suppkey", "l_shipdate", "annual", by=["s_nationkey"]
    )


@_query
def fact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.lookup_fact(_table(spark, folder, "part"), ["p_brand", "p_type"])


@_query
def fact_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.snapshot_fact(
        _table(spark, folder, "orders"),
        n_orders=F.count(F.lit(1)),
        n_open=F.count_if(F.col("o_orderstatus") == "O"),
        total=F.round(F.sum("o_totalprice"), 2),
    )


@_query
def fact_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.breakdown_fact(
        _table(spark, folder, "lineitem"),
        "l_shipdate",
        ["l_returnflag", "l_linestatus"],
        "monthly",
        n=F.count(F.lit(1)),
        quantity=F.round(F.sum("l_quantity"), 2),
    )


# --- Evaluation -------------------------------------------------------------

_MONTH = "date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd')"
_MONTHLY = f"SELECT {_MONTH} AS period, count(*) AS value FROM orders"
_DAY = "date_format(ts, 'yyyy-MM-dd')"

# (name, statement, start, end, granularity, tables): one entry per status code.
CODE_METRICS = [
    ("pass", f"{_MONTHLY} GROUP BY 1 ORDER BY 1", "1990-01-01", "2010-12-01", "monthly", "orders"),
    ("blank", "  ", "", "", "monthly", ""),
    ("bad_sql", "SELECT o_missing, 1 FROM orders", "", "", "monthly", "orders"),
    ("runtime_error", "SELECT o_orderdate, 1 DIV (o_orderkey - o_orderkey) FROM orders", "", "", "tick", "orders"),
    ("one_column", "SELECT count(*) FROM lineitem", "", "", "monthly", "lineitem"),
    ("zero_rows", f"{_MONTHLY} WHERE o_totalprice < 0 GROUP BY 1", "", "", "monthly", "orders"),
    ("sparse", "SELECT date_format(date_trunc('year', l_shipdate), 'yyyy-MM-dd') AS y, sum(l_quantity) AS v "
     "FROM lineitem WHERE l_shipdate < DATE '1997-01-01' GROUP BY 1 ORDER BY 1",
     "1990-01-01", "2010-01-01", "annual", "lineitem"),
    ("high_nulls", f"SELECT {_MONTH} AS p, CASE WHEN max(o_orderkey) % 4 = 0 THEN NULL ELSE sum(o_totalprice) END "
     "AS v FROM orders GROUP BY 1 ORDER BY 1", "", "", "monthly", "orders"),
    ("extra_cols", f"SELECT {_MONTH} AS p, o_orderpriority, count(*) FROM orders GROUP BY 1, 2 ORDER BY 1, 2",
     "", "", "monthly", "orders"),
    ("three_numbers", f"SELECT {_DAY} AS p, count(*) AS n, avg(value) AS a FROM events GROUP BY 1 ORDER BY 1",
     "2023-12-01", "2024-12-01", "daily", "events"),
    ("constant", f"SELECT {_DAY} AS p, count(DISTINCT event_type) AS v FROM events GROUP BY 1 ORDER BY 1",
     "", "", "daily", "events"),
    ("bad_dates", "SELECT p_brand, count(*) AS v FROM part GROUP BY 1 ORDER BY 1", "", "", "monthly", "part"),
    ("date_mismatch", f"{_MONTHLY} GROUP BY 1 ORDER BY 1", "1996-01-01", "1999-12-01", "monthly", "orders"),
    ("descending", f"{_MONTHLY} GROUP BY 1 ORDER BY 1 DESC", "1994-01-01", "1996-01-01", "monthly", "orders"),
    ("period_boundary", f"{_MONTHLY} GROUP BY 1 ORDER BY 1", "1990-01-15", "2010-12-31", "monthly", "orders"),
    ("duplicate", f"  {_MONTHLY.lower().replace('yyyy-mm-dd', 'yyyy-MM-dd')} GROUP  BY 1 ORDER BY 1 ; ",
     "1990-01-01", "2010-12-01", "monthly", "orders"),
    ("tick", "SELECT l_shipdate, l_extendedprice FROM lineitem ORDER BY l_shipdate, l_extendedprice",
     "1990-01-01", "2010-12-31", "tick", "lineitem"),
]

CODE_FACTS = [
    ("lookup", "SELECT DISTINCT p_brand, p_type FROM part"),
    ("snapshot", "SELECT count(*) AS n FROM lineitem"),
    ("empty", "SELECT * FROM events WHERE event_type = 'none'"),
    ("blank", ""),
    ("bad", "SELECT x FROM no_such_table"),
]


def _code_metrics(spark: SparkSession) -> DataFrame:
    rows = [
        ("codes", i, name, name, sql, (start, end), gran, "count", used.split(","), "high", "", "")
        for i, (name, sql, start, end, gran, used) in enumerate(CODE_METRICS)
    ]
    return spark.createDataFrame(rows, METRIC_ROW)


def _code_facts(spark: SparkSession) -> DataFrame:
    rows = [("codes", i, n, n, sql, [], "", "") for i, (n, sql) in enumerate(CODE_FACTS)]
    return spark.createDataFrame(rows, FACT_ROW)


def _error_kind() -> Column:
    """Texts of SQL errors differ between engines and are compared as one word."""
    plain = F.col("sql_ok") | (F.col("error") == evaluate.NO_SQL)
    return F.when(plain, F.col("error")).otherwise("sql_error")


@_query
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    _open(spark, folder)
    entries = _code_metrics(spark)
    results = evaluate.mark_duplicates(
        evaluate.evaluate_metrics(spark, entries), evaluate.duplicate_sql(entries)
    )
    return _rounded(results, 4, *_MEASURED).select(
        "name", "sql_ok", _error_kind().alias("error"), "n_cols", "n_rows", "null_rate", "value_min",
        "value_max", "actual_start", "actual_end", "date_range_ok", "period_boundary_ok",
        "date_col_ok", "duplicate_of", "status",
    )


@_query
def eval_facts(spark: SparkSession, folder: str) -> DataFrame:
    _open(spark, folder)
    results = evaluate.evaluate_facts(spark, _code_facts(spark))
    return results.select("name", "sql_ok", _error_kind().alias("error"), "n_cols", "n_rows", "status")


@_query
def eval_family(spark: SparkSession, folder: str) -> DataFrame:
    results = _metric_results(spark, folder)
    return _rounded(results, 6, *_MEASURED).select(
        "catalogue_id", "pos", "name", "sql_ok", "error", "n_cols", "n_rows", "null_rate",
        "value_min", "value_max", "actual_start", "actual_end", "date_range_ok",
        "period_boundary_ok", "date_col_ok", "duplicate_of", "status",
    )


@_query
def eval_proposal(spark: SparkSession, folder: str) -> DataFrame:
    """Profile, propose and evaluate: every proposed metric with its status."""
    snapshot = _snapshot(spark, folder)
    proposed = propose.propose_metrics(snapshot)
    results = evaluate.evaluate_metrics(spark, proposed)
    return results.select("name", "sql_ok", "error", "n_rows", "status")


@_query
def eval_proposed_facts(spark: SparkSession, folder: str) -> DataFrame:
    snapshot = _snapshot(spark, folder)
    results = evaluate.evaluate_facts(spark, propose.propose_facts(snapshot))
    return results.select("name", "sql_ok", "error", "n_cols", "n_rows", "status")


@_query
def duplicate_sql(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.duplicate_sql(_metric_entries(spark, folder))


@_query
def warning_codes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.warning_codes(_metric_results(spark, folder))


@_query
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    entries, facts = pin(_metric_entries(spark, folder)), _fact_entries(spark, folder)
    mentions = coverage.table_mentions(entries, facts)
    missing = coverage.uncovered_tables(entries, _db_tables(spark), mentions)
    return catalogues.evaluation_report(_metric_results(spark, folder, entries), facts, missing)


@_query
def coerced_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = _input(spark, folder, inputs.MIXED_VALUES)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "event_id",
        coerce.to_value(F.col("number_text"), kinds["number_text"]).alias("value"),
        coerce.reads_as_date(F.col("date_text"), kinds["date_text"]).alias("is_date"),
    )


# --- SQL text, coverage -----------------------------------------------------


@_query
def tables_referenced(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    return entries.select("pos", F.array_join(text.tables_referenced(F.col("sql")), ",").alias("tables"))


# (name, statement with one value in it): what the text rule and Spark see differs.
RESOLVED_FORMS = [
    ("plain", "SELECT o_orderdate, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '{p}' GROUP BY 1"),
    ("cte", "WITH big AS (SELECT o_custkey AS k, o_totalprice * 2 AS t FROM orders WHERE o_orderpriority = '{p}') "
     "SELECT c_mktsegment, sum(t) AS v FROM big JOIN customer ON k = c_custkey GROUP BY 1"),
    ("comma", "SELECT n_name, count(c_custkey) AS v FROM nation, customer, orders WHERE n_nationkey = c_nationkey "
     "AND c_custkey = o_custkey AND o_orderpriority = '{p}' GROUP BY 1"),
    ("filter", "SELECT s_name, s_acctbal AS v FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation "
     "WHERE n_name <> '{p}')"),
    ("union", "SELECT p_name AS a, p_retailprice AS v FROM part UNION ALL SELECT o_orderstatus, o_totalprice FROM orders "
     "WHERE o_orderpriority = '{p}'"),
    ("scalar", "SELECT l_shipdate, l_tax + (SELECT max(p_retailprice) FROM part) AS v FROM lineitem WHERE '{p}' <> ''"),
    ("window", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate) AS v FROM (SELECT * FROM orders) x "
     "WHERE o_orderpriority = '{p}'"),
    ("broken", "SELECT o_missing FROM orders WHERE o_orderpriority = '{p}'"),
]


@_query
def tables_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Tables and sources of statements as Spark resolves them, beside what their text shows:
    eight forms for each priority of an order."""
    priorities = _open(spark, folder)["orders"].select("o_orderpriority").distinct()
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.lit(q).alias("text")) for n, q in RESOLVED_FORMS])
    entries = priorities.withColumn("f", F.explode(forms)).select(
        "o_orderpriority", "f.form", F.replace("f.text", F.lit("{p}"), "o_orderpriority").alias("sql"),
        F.array(F.lit("orders"), F.lit("nation")).alias("tables_used"),
    )
    resolved = pin(lineage.resolved_tables(spark, entries))
    ghosts = lineage.resolved_ghosts(entries, resolved).select("sql", _list("ghosts").alias("ghosts"))
    last = F.element_at("columns", -1)["sources"]
    return entries.join(resolved, "sql").join(ghosts, "sql", "left").select(
        "o_orderpriority", "form", "ok", _list("tables").alias("tables"), F.array_join(last, ",").alias("sources"),
        F.array_join(text.tables_referenced(F.col("sql")), ",").alias("by_text"), "ghosts",
    )


@_query
def ghost_tables(spark: SparkSession, folder: str) -> DataFrame:
    return gate.ghost_violations(_metric_entries(spark, folder))


@_query
def sql_lint(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    return entries.select(
        "pos",
        text.is_select(F.col("sql")).alias("is_select"),
        text.strip_semicolons(F.col("sql")).alias("stored_sql"),
        text.normalise_sql(F.col("sql")).alias("normal_sql"),
    )


@_query
def fk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    exempt = spark.createDataFrame([("Region",), ("part",)], "table_name string")
    waived = spark.createDataFrame([(["customer", "nation"],)], "pair array<string>")
    pairs = coverage.foreign_key_pairs(_foreign_keys(spark), exempt, waived)
    return coverage.uncovered_pairs(entries, entries, pairs)


@_query
def fk_waivers(spark: SparkSession, folder: str) -> DataFrame:
    waived = coverage.waived_pairs(_input(spark, folder, inputs.REJECTIONS))
    return waived.select(_list("pair").alias("pair"), "n_rejections", "waived")


@_query
def table_coverage(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    mentions = coverage.table_mentions(entries, _fact_entries(spark, folder))
    return coverage.uncovered_tables(entries, _db_tables(spark), mentions)


@_query
def covered_tables(spark: SparkSession, folder: str) -> DataFrame:
    mentions = coverage.table_mentions(_metric_entries(spark, folder), _fact_entries(spark, folder))
    return coverage.covered_count(_db_tables(spark), mentions)


@_query
def required_coverage(spark: SparkSession, folder: str) -> DataFrame:
    required = dimensions.table_classes(_snapshot(spark, folder, frequencies=False)).where("is_required")
    entries = _metric_entries(spark, folder)
    return coverage.required_uncovered(entries, required, entries)


# --- Refinement -------------------------------------------------------------


@_query
def snap_periods(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    gran = F.col("granularity")
    return entries.select(
        "pos",
        periods.snap_to_period(F.col("declared_start"), gran).alias("snapped_start"),
        periods.snap_to_period(F.col("declared_end"), gran).alias("snapped_end"),
    )


@_query
def patched_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return refine.patched_ranges(_metric_results(spark, folder)).select("pos", "new_start", "new_end")


@_query
def patched_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics with patched ranges in place, evaluated again."""
    entries = pin(_metric_entries(spark, folder))
    patches = refine.patched_ranges(_metric_results(spark, folder, entries))
    patched = refine.apply_patches(entries, patches)
    again = patched.select(
        "catalogue_id", "pos", "name", "confidence", "granularity", "unit",
        F.col("time_range.start").alias("declared_start"),
        F.col("time_range.end").alias("declared_end"), "n_cols", "sql_error", "sql_ok",
    )
    results = evaluate.evaluate_family(again, spark.sql(inputs.CUSTOMER_SERIES), "pos")
    return results.select("pos", "declared_start", "declared_end", "error", "status")


@_query
def issue_routing(spark: SparkSession, folder: str) -> DataFrame:
    issues = refine.needs_investigation(_metric_results(spark, folder), _fact_results(spark, folder))
    return issues.select("kind", "catalogue_id", "pos", "name", "status", "error")


@_query
def issue_details(spark: SparkSession, folder: str) -> DataFrame:
    issues = refine.needs_investigation(_metric_results(spark, folder), _fact_results(spark, folder))
    return refine.issue_details(issues).select("kind", "pos", "name", "detail")


def _actions(entries: DataFrame, results: DataFrame) -> DataFrame:
    return refine.refine_actions(results, entries.select("catalogue_id", "name", "n_categories"))


def _refined_names(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Names after refinement: removed and moved ones gone, split ones renamed."""
    actions = _actions(entries, results).where("action NOT IN ('remove', 'move_to_facts')")
    renamed = F.when(F.col("action") == "split", F.concat("name", F.lit(" (A)"))).otherwise(F.col("name"))
    return actions.select("catalogue_id", renamed.alias("name"))


# Statements of more than two columns: category second, category last, five values, one name
# twice, too many values, no category, no number.
_ORDER_MONTH = "SELECT date_format(o_orderdate, 'yyyy-MM') AS period"
SPLIT_METRICS = [
    ("Status", f"{_ORDER_MONTH}, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"),
    (
        "Flag",
        "SELECT date_format(l_shipdate, 'yyyy-MM') AS period, sum(l_quantity) AS v, l_returnflag "
        "FROM lineitem GROUP BY 1, 3",
    ),
    ("Event", "SELECT date_format(ts, 'yyyy-MM-dd') AS period, event_type AS x, count(*) AS x FROM events GROUP BY 1, 2"),
    ("Customers", f"{_ORDER_MONTH}, CAST(o_custkey % 7 AS STRING) AS c, count(*) AS n FROM orders GROUP BY 1, 2"),
    ("Numbers", f"{_ORDER_MONTH}, count(*) AS n, 2.5 AS a FROM orders GROUP BY 1"),
    ("Texts", f"{_ORDER_MONTH}, o_orderstatus, max(o_orderpriority) AS p FROM orders GROUP BY 1, 2"),
]


@_query
def split_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Refinement of wide statements: metrics by category, the rest as facts, with their rows."""
    _open(spark, folder)
    rows = [
        ("wide", i, name, name, sql, ("", ""), "monthly", "count", [], "high", "", "")
        for i, (name, sql) in enumerate(SPLIT_METRICS)
    ]
    refined = workflow.refine_catalogue(
        spark, spark.createDataFrame(rows, METRIC_ROW), spark.createDataFrame([], FACT_ROW)
    )
    metrics_ = refined.metric_results.select(F.lit("METRIC").alias("kind"), "name", "sql_ok", "n_rows")
    return metrics_.unionByName(
        refined.fact_results.select(F.lit("FACT").alias("kind"), "name", "sql_ok", "n_rows")
    )


@_query
def refine_actions(spark: SparkSession, folder: str) -> DataFrame:
    entries = pin(_metric_entries(spark, folder))
    results = _metric_results(spark, folder, entries)
    return _actions(entries, results).select("pos", "name", "action", "note")


@_query
def catalogue_diff(spark: SparkSession, folder: str) -> DataFrame:
    entries = pin(_metric_entries(spark, folder))
    return refine.name_changes(entries, _refined_names(entries, _metric_results(spark, folder, entries)))


@_query
def refinement_summary(spark: SparkSession, folder: str) -> DataFrame:
    entries = pin(_metric_entries(spark, folder))
    results = _metric_results(spark, folder, entries)
    return refine.refinement_summary(
        results,
        pin(_refined_names(entries, results)),
        refine.patched_ranges(results),
        refine.needs_investigation(results, _fact_results(spark, folder)),
    )


@_query
def refined_choice(spark: SparkSession, folder: str) -> DataFrame:
    results, facts = _metric_results(spark, folder), _fact_results(spark, folder)
    columns = ["catalogue_id", "name"]
    chosen, chosen_facts = refine.choose_refined(
        results.where("status = 'PASS' AND n_rows > 8").select(*columns),
        facts.where("status = 'PASS' AND n_rows > 2").select(*columns),
        results.select(*columns),
        facts.select(*columns),
    )
    return chosen.withColumn("kind", F.lit("METRIC")).unionByName(
        chosen_facts.withColumn("kind", F.lit("FACT"))
    )


# --- Catalogue documents ----------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogues to write as documents: model, connection, run_index and metrics."""
    entries = _metric_entries(spark, folder)
    given = entries.select("*", F.lit("").alias("description"), F.lit("").alias("agent_notes"), F.col("metric_group").alias("group"))
    metric = F.struct(*[F.col(f.name) for f in METRIC.fields])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", metric.alias("m")))), lambda x: x["m"])
    return given.groupBy("label", "db_stem").agg(listed.alias("measurable_metrics")).select(
        F.col("label").alias("model"),
        F.concat(F.lit("parquet://files/"), "db_stem").alias("connection"),
        F.length("db_stem").alias("run_index"),
        "measurable_metrics",
    )


@_query
def catalogue_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogues written as files, found by folder and read back: one row per metric,
    the last of a repeated name."""
    root = _scratch(spark)
    catalogues.write_files(_documents(spark, folder), root)
    read = catalogues.read_catalogues(spark, catalogues.find_catalogues(spark, [root]))
    rows = catalogues.by_name(catalogues.metric_rows(read))
    known = read.select("catalogue_id", "label", "db_stem", "run_index")
    return rows.join(known, "catalogue_id").select(
        "label", "db_stem", "run_index", "pos", "name", "sql", _list("tables_used").alias("tables"), "granularity",
        F.col("time_range.start").alias("declared_start"),
    )


@_query
def appended_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of the same catalogues, appended and read back; no run hides the other."""
    docs, root = _documents(spark, folder).drop("run_index"), _scratch(spark)
    for run in ("first", "second"):
        catalogues.write_catalogues(docs, root, run)
    read = catalogues.read_written(spark, root)
    rows = catalogues.by_name(catalogues.metric_rows(read)).join(read.select("catalogue_id", "model"), "catalogue_id")
    return rows.groupBy("model").agg(
        F.countDistinct("catalogue_id").alias("n_catalogues"), F.count(F.lit(1)).alias("n_metrics")
    )


@_query
def broken_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document file per supplier, some cut off or of other content: what is read of
    them, and what is put aside with its reason."""
    root = _scratch(spark)
    docs = _input(spark, folder, inputs.DOCUMENT_FILES)
    docs.repartition(_tasks(spark), "s_suppkey").write.partitionBy("s_suppkey").text(f"{root}/files")
    read, left = catalogues.read_documents(spark, [f"{root}/files"])
    supplier = F.regexp_extract("path", "/s_suppkey=([0-9]+)/", 1).cast("bigint").alias("s_suppkey")
    names = F.array_join(F.transform("measurable_metrics", lambda m: m["name"]), ",")
    whole = read.select(supplier, F.lit("").alias("reason"), "db_stem", names.alias("names"))
    return whole.unionByName(left.select(supplier, "reason"), allowMissingColumns=True)


@_query
def compared_catalogues(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue files of two models, found in their folders, evaluated on the tables and
    ranked: one metric for each status of an order, broken in the second model."""
    found = _open(spark, folder, "orders")
    metric = F.concat(
        F.lit(f"SELECT {_MONTH} AS period, count(*) AS value FROM orders WHERE "), "c", F.lit(" = '"),
        "o_orderpriority", F.lit("' GROUP BY 1 ORDER BY 1"),
    )
    priorities = found["orders"].select("o_orderpriority").distinct()
    kinds = [("sound", "o_orderpriority"), ("broken", "o_missing")]
    entries = priorities.withColumn("k", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("c")) for m, c in kinds]))).select(
        "k.model", "k.c", "o_orderpriority"
    )
    given = {"name": F.col("o_orderpriority"), "sql": metric, "granularity": F.lit("monthly"), "unit": F.lit("count"), "confidence": F.lit("high")}
    given |= {"tables_used": F.array(F.lit("orders")), "time_range": F.struct(F.lit("").alias("start"), F.lit("").alias("end"))}
    row = F.struct(*[given.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in METRIC.fields])
    docs = entries.groupBy("model").agg(F.sort_array(F.collect_list(row)).alias("measurable_metrics")).select(
        "model", F.lit("parquet://files/shop").alias("connection"), F.lit(3).alias("run_index"), "measurable_metrics"
    )
    root = _scratch(spark)
    catalogues.write_files(docs, root)
    ranked, _, unmatched = workflow.compare_catalogues(spark, {"parquet://here/shop": found}, [root])
    label = F.element_at(F.split("catalogue_id", "/"), -2).alias("label")
    missing = unmatched.count()
    return ranked.select("db_stem", label, F.col("rank").cast("bigint").alias("rank"), F.lit(missing).cast("bigint").alias("unmatched")).join(
        docs.select(F.col("model").alias("label"), F.size("measurable_metrics").cast("bigint").alias("n_metrics")), "label"
    )


@_query
def paired_results(spark: SparkSession, folder: str) -> DataFrame:
    entries = pin(_metric_entries(spark, folder))
    results = _metric_results(spark, folder, entries)
    pairs = workflow.pair_results(entries, results)
    return pairs.select("catalogue_id", "pos", "name", "sql", "tables_csv", "status", "error", "n_rows")


@_query
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of the evaluation report, read back from their JSON text."""
    items = catalogues.report_items(_metric_results(spark, folder))
    plain = ["name", "status", "confidence", "granularity", "unit", "actual_start", "actual_end", "duplicate_of", "error"]
    return items.select(
        "catalogue_id",
        "pos",
        *[F.get_json_object("item", f"$.{c}").alias(c) for c in plain],
        F.get_json_object("item", "$.n_rows").cast("bigint").alias("n_rows"),
        F.get_json_object("item", "$.null_rate").cast("double").alias("null_rate"),
    )


@_query
def listed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names a broker lists; repeated names of a catalogue once."""
    served = broker.Broker(spark, _metric_entries(spark, folder), _fact_entries(spark, folder))
    names = served.list_metrics().withColumn("kind", F.lit("METRIC"))
    return names.unionByName(served.list_facts().withColumn("kind", F.lit("FACT")))


@_query
def listed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables found by listing the folder, with their rows."""
    found = tables.open_folder(spark, folder)
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in found.items()]
    return tables.union_all(counts)


# --- Serving ----------------------------------------------------------------


def _broker(spark: SparkSession, folder: str) -> broker.Broker:
    _open(spark, folder)
    return broker.Broker(spark, _code_metrics(spark), _code_facts(spark))


@_query
def broker_fetch(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_broker(spark, folder).fetch("high_nulls"), 2, "value")


@_query
def broker_info(spark: SparkSession, folder: str) -> DataFrame:
    """What comes with a fetched series, for an equal and an approximate name."""
    served, rows = _broker(spark, folder), None
    for asked in ("THREE_NUMBERS", "date mismatch"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)
            series, info = served.fetch_with_info(asked)
        one = series.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(asked).alias("asked"), *[F.lit(v).alias(k) for k, v in info.items()], "n_rows"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@_query
def broker_describe(spark: SparkSession, folder: str) -> DataFrame:
    """Whole entries by name: a metric of one customer and a fact of one supplier."""
    metrics, facts = pin(_metric_entries(spark, folder)), pin(_fact_entries(spark, folder))
    served = broker.Broker(spark, metrics, facts)
    wanted = metrics.orderBy(F.desc("pos")).first()["name"], facts.orderBy("pos").first()["name"]
    metric = served.describe(wanted[0].upper()).select("name", F.lit("METRIC").alias("kind"), "catalogue_id", "pos", "tables_csv")
    fact = served.describe_fact(wanted[1]).select("name", F.lit("FACT").alias("kind"), "catalogue_id", "pos", "tables_csv")
    return metric.unionByName(fact)


@_query
def broker_window(spark: SparkSession, folder: str) -> DataFrame:
    return _broker(spark, folder).fetch("PASS", "1996-03-15", "1998-06-30")


@_query
def broker_window_inclusive(spark: SparkSession, folder: str) -> DataFrame:
    return _broker(spark, folder).fetch("pass", "1996-03-15", "1998-06-30", inclusive_end=True)


@_query
def broker_query(spark: SparkSession, folder: str) -> DataFrame:
    return _broker(spark, folder).query("lookup")


@_query
def fuzzy_match(spark: SparkSession, folder: str) -> DataFrame:
    names = _input(spark, folder, inputs.PART_NAMES)
    requests = _input(spark, folder, inputs.PART_REQUESTS)
    return _rounded(broker.match_names(requests, names), 3, "score")


@_query
def fuzzy_match_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of requests and names that have half of their words in common."""
    names = _input(spark, folder, inputs.PART_NAMES)
    requests = _input(spark, folder, inputs.PART_REQUESTS)
    return _rounded(similar_names.similar_by_words(requests, names, 0.5), 6, "overlap")


@_query
def sql_preview(spark: SparkSession, folder: str) -> DataFrame:
    _open(spark, folder)
    shown = [
        ("grouped", "-- by priority\nSELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1"),
        ("short", "SELECT count(*) AS n, max(l_quantity) AS q FROM lineitem"),
        ("long", "SELECT text FROM documents ORDER BY doc_id"),
        ("none", "SELECT * FROM events WHERE value < -1000"),
        ("refused", "WITH x AS (SELECT * FROM part) SELECT count(*) FROM x"),
    ]
    parts = [tables.preview(spark, sql).withColumn("name", F.lit(name)) for name, sql in shown]
    return tables.union_all(parts)


@_query
def runnable_entries(spark: SparkSession, folder: str) -> DataFrame:
    _open(spark, folder)
    return gate.runnable(spark, _code_metrics(spark)).select("name")


# --- Scores and rankings ----------------------------------------------------


def _scores(spark: SparkSession, folder: str, judged: bool = False) -> DataFrame:
    entries, facts = pin(_metric_entries(spark, folder)), _fact_entries(spark, folder)
    scores = None
    if judged:
        scores = scoring.judge_scores(_input(spark, folder, inputs.JUDGE_RESPONSES))
    return scoring.catalogue_scores(
        _catalogues(entries),
        entries,
        _metric_results(spark, folder, entries),
        facts,
        coverage.covered_count(_db_tables(spark), coverage.table_mentions(entries, facts)),
        len(inputs.TABLES),
        scores,
    )


@_query
def catalogue_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).drop("semantic_score", "combined", "run_index")


@_query
def stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison reports of all databases, written in two goes and read back together."""
    scores = pin(_scores(spark, folder).select("db_stem", "catalogue_id", "composite"))
    root = _scratch(spark)
    early = F.col("db_stem") < "JAPAN"
    for some in (scores.where(early).withColumn("composite", F.lit(-1.0)), scores.where(~early), scores.where(early)):
        catalogues.write_scores(some, root)
    return catalogues.read_scores(spark, root, scores.schema).select(
        "db_stem", "catalogue_id", "composite"
    )


@_query
def catalogue_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = scoring.rank_within_database(_scores(spark, folder))
    return ranked.select("db_stem", "catalogue_id", "composite", F.col("rank").cast("bigint").alias("rank"))


@_query
def semantic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = scoring.rank_within_database(_scores(spark, folder, judged=True))
    return ranked.select(
        "db_stem", "catalogue_id", "semantic_score", "combined", F.col("rank").cast("bigint").alias("rank")
    )


@_query
def model_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = scoring.model_ranking(_scores(spark, folder))
    return ranked.select("label", "n_dbs", "score", F.col("rank").cast("bigint").alias("rank"))


@_query
def judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.judge_scores(_input(spark, folder, inputs.JUDGE_RESPONSES))


@_query
def semantic_join(spark: SparkSession, folder: str) -> DataFrame:
    scores = scoring.judge_scores(_input(spark, folder, inputs.JUDGE_RESPONSES)).where("score > 2")
    joined = scoring.attach_scores(_metric_entries(spark, folder), scores)
    return joined.select("pos", "name", "semantic")


@_query
def proposal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scoring.proposal_spans(_metric_entries(spark, folder)), 6, "avg_span_months")


@_query
def database_match(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder)
    known = _table(spark, folder, "nation").where("n_regionkey <> 2").select(F.col("n_name").alias("db_stem"))
    matched, unmatched = scoring.match_databases(_catalogues(entries), known)
    both = matched.withColumn("matched", F.lit(True)).unionByName(unmatched.withColumn("matched", F.lit(False)))
    return both.select("catalogue_id", "db_stem", "matched")


@_query
def metric_groups(spark: SparkSession, folder: str) -> DataFrame:
    entries = _metric_entries(spark, folder).withColumn("group", F.col("metric_group"))
    known = entries.select("catalogue_id", F.lit("orders").alias("name")).distinct()
    return assemble.metric_groups(entries, known)


# --- Catalogue documents ----------------------------------------------------


@_query
def catalogue_violations(spark: SparkSession, folder: str) -> DataFrame:
    return gate.item_violations(_input(spark, folder, inputs.SUBMISSIONS))


@_query
def submission_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gate.submission_gate(_input(spark, folder, inputs.SUBMISSIONS), min_metrics=1)


@_query
def submission_decision(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each submission of a run, with the pairs waived by then."""
    keys = spark.createDataFrame(
        [("orders", "customer"), ("Lineitem", "orders"), ("lineitem", "part")], "from_table string, to_table string"
    )
    lookups = spark.createDataFrame([("Part",)], "table_name string")
    required = spark.createDataFrame([("orders",), ("Lineitem",)], "table_name string")
    decided = decision.decide(
        _input(spark, folder, inputs.ATTEMPTS, spread="part"), keys, lookups, required, min_iterations=2, min_metrics=2
    )
    return decided.select(
        "run", "attempt", "status", "first_reason",
        F.array_join(F.transform("reasons", lambda r: r["rule"]), ",").alias("rules"),
        F.array_join(F.transform("reasons", lambda r: r["detail"]), "|").alias("details"),
        _list("waived").alias("waived"),
    )


@_query
def submitted_notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _input(spark, folder, inputs.SUBMISSIONS)
    return rows.select(
        "submission_id", F.array_join(json_text.text_list(F.col("data"), "data_quality_notes"), ",").alias("notes")
    )


@_query
def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = _input(spark, folder, inputs.SUBMISSIONS).select(
        F.col("submission_id").alias("catalogue_id"),
        F.get_json_object("data", "$.description").alias("description"),
        F.nullif(F.get_json_object("data", "$.overview"), F.lit("o")).alias("overview"),
    )
    return gate.missing_fields(rows)


@_query
def catalogue_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Table summaries of every catalogue, merged with measured counts and notes."""
    found = _open(spark, folder)
    found["orders"] = found["orders"].withColumn(
        "o_totalprice", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END")
    )
    columns = profile.profile_columns(spark, found, inputs.PRIMARY_KEYS, frequencies=False)
    snapshot = profile.Snapshot(columns, _foreign_keys(spark), data=found)
    entries = _metric_entries(spark, folder)
    submitted = coverage.table_mentions(entries, _fact_entries(spark, folder)).select(
        "catalogue_id",
        F.col("table_name").alias("name"),
        F.lit(7).cast("bigint").alias("row_count"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<string>").alias("key_columns"),
    )
    return assemble.merge_tables(submitted, snapshot).select(
        "catalogue_id", "name", "row_count", "description", _list("data_quality_notes").alias("notes")
    )


@_query
def restored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Table summaries after refinement: known tables with their own counts and notes again."""
    entries = _metric_entries(spark, folder)
    used = entries.select("catalogue_id", F.explode("tables_used").alias("name"))
    known = used.groupBy("catalogue_id", "name").agg(F.count(F.lit(1)).alias("row_count"))
    known = known.withColumn("data_quality_notes", F.array(F.concat(F.lit("seen in "), "name")))
    told = {"row_count": F.lit(-1).cast("bigint"), "data_quality_notes": F.array(F.lit("told"))}
    refined = known.where("name <> 'events'").withColumns(told)
    fresh = entries.select("catalogue_id", F.lit("fresh").alias("name")).distinct().withColumns(told)
    restored = refine.restore_tables(refined.unionByName(fresh.select(*refined.columns)), known)
    return restored.select("catalogue_id", "name", "row_count", _list("data_quality_notes").alias("notes"))


@_query
def built_catalogues(spark: SparkSession, folder: str) -> DataFrame:
    """Whole catalogues: submitted entries, and what the snapshot knows before them."""
    snapshot = _snapshot(spark, folder, frequencies=False)
    metrics = _metric_entries(spark, folder).select("catalogue_id", "pos", "name", "sql", "tables_used")
    facts = _fact_entries(spark, folder).select("catalogue_id", "pos", "name", "tables_used")
    submitted = coverage.table_mentions(metrics, facts).select(
        "catalogue_id", F.col("table_name").alias("name"), F.lit(7).cast("bigint").alias("row_count"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("key_columns"),
    )
    proposal = metrics.select("catalogue_id").distinct().select(
        "catalogue_id", F.lit("d").alias("description"), F.lit(None).cast("string").alias("overview"),
        F.array(F.lit("submitted")).alias("data_quality_notes"),
        F.lit(None).cast("array<struct<term:string,definition:string>>").alias("key_terms"),
    )
    built = assemble.build_catalogue(proposal, metrics, facts, submitted, snapshot, "m")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return built.select(
        "catalogue_id", "model", "description", "overview", size("measurable_metrics").alias("n_metrics"),
        size("queryable_facts").alias("n_facts"), size("tables").alias("n_tables"), size("table_relationships").alias("n_links"),
        F.element_at("measurable_metrics", 1)["name"].alias("first_metric"), F.element_at("data_quality_notes", -1).alias("last_note"),
        periods.day_prefix(F.col("time_coverage.start")).alias("first_day"),
    )


@_query
def relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Declared single-column keys with the number of rows on their child side."""
    counts = profile_table_counts(spark, folder).select(F.col("table_name").alias("table_a"), "n_rows")
    return assemble.relationships(_foreign_keys(spark)).join(counts, "table_a")


@_query
def redacted_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = _input(spark, folder, inputs.CONNECTIONS)
    source = F.col("connection")
    return rows.select(
        "source_id",
        text.redact(source).alias("redacted"),
        text.db_stem(source).alias("db_stem"),
        text.output_stem(source).alias("output_stem"),
    )


# --- Logs and usage ---------------------------------------------------------


@_query
def query_log_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = querylog.dedup_queries(_input(spark, folder, inputs.QUERY_LOG))
    return querylog.shorten(kept)


@_query
def query_log_totals(spark: SparkSession, folder: str) -> DataFrame:
    log = _input(spark, folder, inputs.QUERY_LOG)
    return querylog.log_totals(log, querylog.dedup_queries(log))


@_query
def query_log_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a run's log with the metrics it proposed."""
    log = _input(spark, folder, inputs.QUERY_LOG)
    return querylog.log_totals(log, querylog.dedup_queries(log), _input(spark, folder, inputs.PROPOSALS))


@_query
def proposal_union(spark: SparkSession, folder: str) -> DataFrame:
    union = querylog.union_proposals(_input(spark, folder, inputs.PROPOSALS))
    return querylog.shorten_proposals(union).withColumn("runs", _list("runs"))


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    book = spark.createDataFrame(inputs.PRICE_BOOK, PRICE_BOOK)
    return usage.call_costs(_input(spark, folder, inputs.CALL_LOG), book)


@_query
def ledger_cost(spark: SparkSession, folder: str) -> DataFrame:
    costed = _costs(spark, folder).select(
        "session", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "model", "cost", "is_default"
    )
    return _rounded(costed, 9, "cost")


@_query
def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = usage.session_totals(_costs(spark, folder), context_window=200_000)
    return _rounded(_rounded(totals, 9, "total_cost"), 6, "avg_cost", "calls_per_minute", "context_pct")


def _minute_text(df: DataFrame) -> DataFrame:
    return df.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@_query
def calls_per_minute(spark: SparkSession, folder: str) -> DataFrame:
    counts = usage.calls_per_minute(_input(spark, folder, inputs.CALL_LOG), ["session"])
    return _minute_text(counts)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Calls from a stream over the event files, one or a folder of them."""
    schema = _table(spark, folder, "events").schema
    files = spark.readStream.schema(schema)
    # A stream reads folders: the table's own, or the one its only file is in.
    table = f"{folder.rstrip('/')}/events.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(path).isDirectory():
        events = files.parquet(table)
    else:
        events = files.option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.select(
        F.col("user_id").alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 10).alias("output_tokens"),
    )


@_query
def stream_calls_per_minute(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from a stream over the event files, one or a folder of them."""
    calls = _event_stream(spark, folder)
    root = _scratch(spark)
    counts = call_stream.stream_calls_per_minute(calls, ["session"])
    call_stream.run_to_files(counts, f"{root}/counts", f"{root}/state")
    return _minute_text(call_stream.latest_counts(spark, f"{root}/counts", ["session"]))


def _scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a local one only in local runs. It goes
    when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        return until_exit(spark, tempfile.mkdtemp(prefix="metricloom-stream-"))
    return until_exit(spark, f"{shared.rstrip('/')}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}")


@_query
def trailing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    used = usage.trailing_tokens(_input(spark, folder, inputs.CALL_LOG), limit=400, expected=100)
    return used.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_query
def stream_trailing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The same tokens in use from a stream of calls, with state and timers."""
    root = _scratch(spark)
    used = stream_windows.stream_trailing_tokens(_event_stream(spark, folder))
    call_stream.run_to_files(used, f"{root}/used", f"{root}/state")
    final = stream_windows.final_tokens(spark, f"{root}/used", limit=400, expected=100)
    return final.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_query
def greedy_minutes(spark: SparkSession, folder: str) -> DataFrame:
    found = usage.greedy_minutes(_input(spark, folder, inputs.CALL_LOG))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_query
def trailing_tokens_total(spark: SparkSession, folder: str) -> DataFrame:
    """One session over all calls: the hot case, spread over time buckets."""
    calls = _input(spark, folder, inputs.CALL_LOG).withColumn("session", F.lit(0))
    used = usage.trailing_tokens(calls, limit=2000, expected=100, seconds=600)
    return used.drop("session").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
