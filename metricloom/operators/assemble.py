"""Assembly of a catalogue from a proposal and a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.dimensions import is_temporal_column
from metricloom.operators.profile import Snapshot
from metricloom.schemas import KEY_TERM, TEXTS

# Null share worth a note, and the size below which a table is small.
NOTED_NULL_RATE = 0.20
SMALL_TABLE = 100


def time_coverage(columns: DataFrame) -> DataFrame:
    """Earliest and latest day over all temporal columns, compared as text."""

    def day(name: str) -> Column:
        return F.when(F.coalesce(name, F.lit("")) != "", F.left(name, F.lit(10)))

    return columns.where(is_temporal_column()).agg(
        F.coalesce(F.min(day("min")), F.lit("")).alias("start"),
        F.coalesce(F.max(day("max")), F.lit("")).alias("end"),
    )


def null_notes(columns: DataFrame) -> DataFrame:
    """A note per column with many nulls."""
    rate = F.col("n_null") / F.col("n_rows")
    share = F.bround(rate * 100, 0).cast("int").cast("string")
    note = F.concat(F.lit("Column "), "column_name", F.lit(": "), share, F.lit("% empty ("), "n_null", F.lit(" rows)"))
    return columns.where((F.col("n_rows") > 0) & (F.col("n_null") > 0) & (rate >= NOTED_NULL_RATE)).select(
        "table_name", "ordinal", "column_name", note.alias("note")
    )


def size_notes(tables: DataFrame) -> DataFrame:
    """A note per small table."""
    note = F.concat(
        F.lit("Table "), "table_name", F.lit(": only "), "n_rows", F.lit(" rows, too few for firm conclusions")
    )
    return tables.where((F.col("n_rows") > 0) & (F.col("n_rows") < SMALL_TABLE)).select(
        "table_name", note.alias("note")
    )


def relationships(foreign_keys: DataFrame) -> DataFrame:
    """Single-column foreign keys as edges; composite ones are left out."""
    return foreign_keys.where("size(from_cols) = 1 AND size(to_cols) = 1").select(
        F.col("from_table").alias("table_a"),
        F.col("to_table").alias("table_b"),
        F.col("from_cols")[0].alias("join_key"),
    )


def merge_tables(submitted: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Submitted table summaries with measured row counts and null notes. A table the
    snapshot does not know keeps its submitted count."""
    notes = null_notes(snapshot.columns).groupBy("table_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "note"))), lambda n: n["note"]
        ).alias("notes")
    )
    measured = (
        snapshot.tables.join(notes, "table_name", "left")
        .select(F.col("table_name").alias("name"), "n_rows", "notes")
    )
    none = F.array().cast(TEXTS)
    return submitted.join(measured, "name", "left").select(
        *[c for c in submitted.columns if c not in _MERGED],
        F.coalesce("n_rows", "row_count", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("key_columns", none).alias("key_columns"),
        F.coalesce("notes", none).alias("data_quality_notes"),
    )


_MERGED = ("row_count", "description", "key_columns", "data_quality_notes")


def metric_groups(metrics: DataFrame, tables: DataFrame) -> DataFrame:
    """Thematic groups per catalogue: the entry's own, else its first known table, else
    Other; ``first_pos`` gives the order in which groups appear.

    Metrics are counted per group and table list before they meet the known tables.
    """
    none = F.array().cast(TEXTS)
    known = tables.groupBy("catalogue_id").agg(F.collect_set("name").alias("known"))
    kinds = metrics.groupBy(
        "catalogue_id",
        F.coalesce("group", F.lit("")).alias("own"),
        F.when(F.coalesce("group", F.lit("")) == "", F.col("tables_used")).alias("used"),
    ).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    primary = F.get(
        F.filter(F.coalesce("used", none), lambda t: F.array_contains(F.coalesce("known", none), t)),
        F.lit(0),
    )
    own = F.when(F.col("own") != "", F.col("own"))
    return (
        kinds.join(known, "catalogue_id", "left")
        .groupBy("catalogue_id", F.coalesce(own, primary, F.lit("Other")).alias("metric_group"))
        .agg(F.min("first_pos").alias("first_pos"), F.sum("n").alias("n_metrics"))
    )


def build_catalogue(
    proposal: DataFrame,
    metrics: DataFrame,
    facts: DataFrame,
    tables: DataFrame,
    snapshot: Snapshot,
    model: str = "",
) -> DataFrame:
    """One nested row per catalogue. Measured notes come before submitted ones.

    ``proposal`` has catalogue_id, description, overview, data_quality_notes and
    key_terms.
    """
    text = F.lit("")
    texts = F.array().cast(TEXTS)
    measured = size_notes(snapshot.tables).agg(F.array_sort(F.collect_list("note")).alias("measured_notes"))
    links = relationships(snapshot.foreign_keys).agg(
        F.collect_list(F.struct("table_a", "table_b", "join_key")).alias("table_relationships")
    )
    coverage = time_coverage(snapshot.columns).select(F.struct("start", "end").alias("time_coverage"))

    def nested(rows: DataFrame, name: str, order: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("catalogue_id", "pos")]
        item = F.struct(*fields)
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item"))))
        return rows.groupBy("catalogue_id").agg(
            F.transform(ordered, lambda r: r["item"]).alias(name)
        )

    merged = merge_tables(tables, snapshot)
    head = proposal.withColumns(
        {
            "measured_notes": measured.scalar(),
            "table_relationships": links.scalar(),
            "time_coverage": coverage.scalar(),
        }
    )
    return (
        head.join(nested(metrics, "measurable_metrics", "pos"), "catalogue_id", "left")
        .join(nested(facts, "queryable_facts", "pos"), "catalogue_id", "left")
        .join(nested(merged, "tables", "name"), "catalogue_id", "left")
        .select(
            "catalogue_id",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("analysed_at"),
            F.lit(model).alias("model"),
            F.lit(snapshot.connection).alias("connection"),
            F.lit(snapshot.dialect).alias("dialect"),
            F.coalesce("description", text).alias("description"),
            F.coalesce("overview", text).alias("overview"),
            "tables",
            "measurable_metrics",
            "queryable_facts",
            "time_coverage",
            F.concat("measured_notes", F.coalesce("data_quality_notes", texts)).alias("data_quality_notes"),
            F.coalesce("key_terms", F.array().cast(f"array<{KEY_TERM.simpleString()}>")).alias("key_terms"),
            "table_relationships",
        )
    )
