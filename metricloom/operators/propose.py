"""Rule-based catalogue proposal: metric and fact entries written from a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.periods import snap_to_period
from metricloom.functions.text import metric_name, quoted_name, quoted_text, title
from metricloom.operators.dimensions import dimension_manifest, is_temporal_column, table_classes
from metricloom.operators.profile import Snapshot
from metricloom.schemas import FACT_ROW, METRIC_ROW


def _monthly_sql(value: Column, source: Column, ts: Column, where: Column | None = None) -> Column:
    condition = F.lit("") if where is None else F.concat(F.lit(" WHERE "), where)
    return F.concat(
        F.lit("SELECT date_format(date_trunc('month', "), ts, F.lit("), 'yyyy-MM-dd') AS period, "),
        value, F.lit(" AS value FROM "), source, condition, F.lit(" GROUP BY 1 ORDER BY 1"),
    )


def _date_columns(snapshot: Snapshot) -> DataFrame:
    """First temporal column of each table, with its range moved to month starts."""
    order = Window.partitionBy("table_name").orderBy("ordinal")
    monthly = F.lit("monthly")

    def month(text: str) -> Column:
        return snap_to_period(F.left(F.coalesce(text, F.lit("")), F.lit(10)), monthly)

    return (
        snapshot.columns.where(is_temporal_column())
        .withColumn("rn", F.row_number().over(order))
        .where("rn = 1")
        .select(
            "table_name",
            F.col("column_name").alias("ts"),
            F.struct(month("min").alias("start"), month("max").alias("end")).alias("time_range"),
        )
    )


def propose_metrics(snapshot: Snapshot, catalogue_id: str = "proposal") -> DataFrame:
    """Monthly metrics for every temporal table: row count, total and average of its
    measures, one count per value of each dimension, and one count per foreign key."""
    dates = _date_columns(snapshot)
    links = snapshot.foreign_keys.where("size(from_cols) = 1 AND size(to_cols) = 1").select(
        F.col("from_table").alias("table_name"),
        F.col("from_cols")[0].alias("column_name"),
        "to_table",
        F.col("to_cols")[0].alias("to_col"),
    )
    source, ts = quoted_name(F.col("table_name")), quoted_name(F.col("ts"))
    one_table = F.array("table_name")

    def entries(rows: DataFrame, name: Column, sql: Column, unit: str, used: Column, note: Column):
        return rows.select(
            F.concat(name, F.lit("")).alias("name"),
            note.alias("description"),
            sql.alias("sql"),
            "time_range",
            F.lit("monthly").alias("granularity"),
            F.lit(unit).alias("unit"),
            used.alias("tables_used"),
            F.lit("high").alias("confidence"),
            F.lit("Built by rule from the column profile.").alias("agent_notes"),
            title(F.col("table_name")).alias("group"),
        )

    counts = entries(
        dates, metric_name(F.col("table_name")), _monthly_sql(F.lit("count(*)"), source, ts), "count",
        one_table, F.concat(F.lit("Rows of "), "table_name", F.lit(" per month")),
    )
    measures = (
        snapshot.columns.where("type_class = 'numeric' AND NOT primary_key")
        .join(dates, "table_name")
        .join(links.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    )
    column = quoted_name(F.col("column_name"))

    def measure(function: str, form: str, prefix: str) -> DataFrame:
        value = F.concat(F.lit(f"{function}("), column, F.lit(")"))
        note = F.concat(F.lit(f"{prefix} of "), "column_name", F.lit(" per month"))
        label = F.concat(F.lit("total_" if form == "count" else ""), F.col("column_name"))
        return entries(
            measures, metric_name(label, form), _monthly_sql(value, source, ts), "value", one_table, note
        )

    dims = (
        dimension_manifest(snapshot)
        .where("via = ''")
        .join(dates, "table_name")
        .withColumn("dim_value", F.explode("values"))
    )
    splits = entries(
        dims,
        metric_name(F.concat_ws("_", "table_name"), "count", F.col("dim_value")),
        _monthly_sql(
            F.lit("count(*)"), source, ts, F.concat(column, F.lit(" = "), quoted_text(F.col("dim_value")))
        ),
        "count",
        one_table,
        F.concat(F.lit("Rows per month where "), "column_name", F.lit(" = "), "dim_value"),
    )
    joined_source = F.concat(
        source, F.lit(" AS a JOIN "), quoted_name(F.col("to_table")), F.lit(" AS b ON a."), column,
        F.lit(" = b."), quoted_name(F.col("to_col")),
    )
    child_dates = links.join(dates, "table_name")
    across = entries(
        child_dates,
        metric_name(F.concat_ws("_", "table_name", F.lit("per"), "to_table", F.lit("rate")), "count"),
        _monthly_sql(
            F.concat(F.lit("count(*) / count(DISTINCT b."), quoted_name(F.col("to_col")), F.lit(")")),
            joined_source,
            F.concat(F.lit("a."), ts),
        ),
        "ratio",
        F.array("table_name", "to_table"),
        F.concat(F.lit("Rows of "), "table_name", F.lit(" per row of "), "to_table", F.lit(" and month")),
    )
    parts = [
        counts, measure("sum", "count", "Total"), measure("avg", "average", "Average"), splits, across,
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    numbered = Window.orderBy("group", "name", "sql")
    return _typed(
        rows.withColumn("catalogue_id", F.lit(catalogue_id)).withColumn(
            "pos", F.row_number().over(numbered) - 1
        ),
        METRIC_ROW,
    )


def propose_facts(snapshot: Snapshot, catalogue_id: str = "proposal") -> DataFrame:
    """A reference fact for every lookup table and a current-state fact for the others."""
    classes = table_classes(snapshot)
    names = snapshot.tables.select("table_name", F.lower("table_name").alias("key"))
    rows = names.join(classes.select(F.col("table_name").alias("key"), "is_lookup"), "key")
    source = quoted_name(F.col("table_name"))
    sql = F.when(F.col("is_lookup"), F.concat(F.lit("SELECT DISTINCT * FROM "), source)).otherwise(
        F.concat(F.lit("SELECT count(*) AS n_rows FROM "), source)
    )
    numbered = Window.orderBy("table_name")
    return _typed(
        rows.select(
            F.lit(catalogue_id).alias("catalogue_id"),
            (F.row_number().over(numbered) - 1).alias("pos"),
            F.concat(
                title(F.col("table_name")), F.when(F.col("is_lookup"), " Lookup").otherwise(" Snapshot")
            ).alias("name"),
            F.concat(F.lit("Contents of "), "table_name").alias("description"),
            sql.alias("sql"),
            F.array("table_name").alias("tables_used"),
            F.lit("State at the time of the run.").alias("agent_notes"),
            title(F.col("table_name")).alias("group"),
        ),
        FACT_ROW,
    )


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
