"""Breakdown dimensions and table roles, read off the column profile.

All inputs here have one row per column, table or foreign key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.profile import DIMENSION_VALUES, TOP_VALUES, Snapshot

# Most distinct values of a dimension; fixed value: most rows of a lookup table.
MAX_DIMENSION_VALUES = DIMENSION_VALUES
MAX_LOOKUP_ROWS = 200

ISO_DATE = r"^\d{4}-\d{2}-\d{2}"


def is_temporal_column() -> Column:
    """Date-typed, or text whose smallest value looks like an ISO date."""
    iso_text = (F.col("type_class") == "text") & F.col("min").rlike(ISO_DATE)
    return (F.col("type_class") == "date") | F.coalesce(iso_text, F.lit(False))


def table_classes(snapshot: Snapshot) -> DataFrame:
    """Role of each table: temporal, junction, lookup, required."""
    tables = snapshot.columns.groupBy(F.lower("table_name").alias("table_name")).agg(
        F.max("n_rows").alias("n_rows"),
        F.bool_or(is_temporal_column()).alias("is_temporal"),
        F.array_sort(F.collect_set(F.lower("column_name"))).alias("cols"),
    )
    linked = (
        snapshot.foreign_keys.select(
            F.lower("from_table").alias("table_name"), F.explode("from_cols").alias("c")
        )
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_set(F.lower("c"))).alias("fk_cols"))
    )
    junction = F.coalesce(F.col("cols") == F.col("fk_cols"), F.lit(False))
    return tables.join(linked, "table_name", "left").select(
        "table_name",
        "n_rows",
        "is_temporal",
        junction.alias("is_junction"),
        (~F.col("is_temporal") | junction).alias("is_lookup"),
        (F.col("is_temporal") & ~junction).alias("is_required"),
    )


def _few_values() -> Column:
    return (F.col("stat_kind") == "categorical") & F.col("n_distinct").between(2, MAX_DIMENSION_VALUES)


def _sorted_values() -> Column:
    return F.array_sort(F.transform("top_values", lambda v: v["value"]))


def label_values(columns: DataFrame) -> DataFrame:
    """Values of the first suitable label column of each small table."""
    order = Window.partitionBy("table_name").orderBy("ordinal")
    return (
        columns.where(~F.col("primary_key") & (F.col("n_rows") <= MAX_LOOKUP_ROWS) & _few_values())
        .withColumn("rn", F.row_number().over(order))
        .where("rn = 1")
        .select(F.col("table_name").alias("to_table"), _sorted_values().alias("label_values"))
    )


def dimension_manifest(snapshot: Snapshot) -> DataFrame:
    """Columns to break metrics down by, with their values; foreign keys to small
    lookup tables take the labels of their target."""
    candidates = snapshot.columns.where(~F.col("primary_key"))
    own = candidates.where(_few_values()).select(
        "table_name", "ordinal", "column_name", F.lit("").alias("via"), _sorted_values().alias("values")
    )
    looks_json = F.exists("values", lambda v: v.startswith("{") | v.startswith("["))
    own = own.where(~looks_json)
    # Where a column takes part in several foreign keys the last one counts.
    links = snapshot.foreign_keys.withColumn("fk_no", F.monotonically_increasing_id()).select(
        F.col("from_table").alias("table_name"),
        F.explode("from_cols").alias("column_name"),
        "to_table",
        "fk_no",
    )
    last = links.groupBy("table_name", "column_name").agg(F.max_by("to_table", "fk_no").alias("to_table"))
    linked = (
        candidates.where(F.col("stat_kind") != "categorical")
        .join(last, ["table_name", "column_name"])
        .join(label_values(snapshot.columns), "to_table")
        .select(
            "table_name", "ordinal", "column_name", F.col("to_table").alias("via"),
            F.col("label_values").alias("values"),
        )
    )
    return own.unionByName(linked)


def manifest_lines(manifest: DataFrame) -> DataFrame:
    via = F.when(F.col("via") == "", "").otherwise(F.concat(F.lit(", named by "), "via"))
    more = F.when(F.size("values") > TOP_VALUES, ", …").otherwise("")
    shown = F.concat(F.array_join(F.slice("values", 1, TOP_VALUES), ", "), more)
    line = F.concat("table_name", F.lit("."), "column_name", via, F.lit(": "), shown)
    return manifest.select("table_name", "ordinal", line.alias("line"))
