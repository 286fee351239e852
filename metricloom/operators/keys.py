"""Keys and references found in the data: sketches propose, exact counts confirm."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.sketches import ERROR, LG_K
from metricloom.session import pin
from metricloom.sources.tables import union_all

KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)
REFERENCE_TYPES = KEY_TYPES[:-1]


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def stem(column: str) -> str:
    """Name without a short prefix: tables that mark their columns by a letter or two."""
    head, _, rest = column.lower().partition("_")
    return rest if rest and len(head) <= 2 else column.lower()


def _states(tables: dict[str, DataFrame], sets: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """(table_name, columns, n_rows, n_full, sketch) of column sets, one scan a table. Rows with
    a null in the set are not sketched."""
    parts = []
    for table, df in tables.items():
        if not sets[table]:
            continue
        aggs, rows = [F.count(F.lit(1)).alias("n")], []
        for i, columns in enumerate(sets[table]):
            full = F.lit(True)
            for c in columns:
                full &= _name(c).isNotNull()
            value = F.concat_ws("\u0001", *[_name(c).cast("string") for c in columns])
            aggs += [
                F.count_if(full).alias(f"f{i}"),
                F.hll_sketch_agg(F.when(full, value), LG_K).alias(f"s{i}"),
            ]
            rows.append(
                F.struct(
                    F.array(*map(F.lit, columns)).alias("columns"),
                    F.col(f"f{i}").alias("n_full"),
                    F.col(f"s{i}").alias("sketch"),
                )
            )
        wide = df.agg(*aggs)
        parts.append(wide.select(F.lit(table).alias("table_name"), F.col("n").alias("n_rows"), F.inline(F.array(*rows))))
    return pin(union_all(parts))


def _unique(states: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """Sets that may be a key: no nulls, and an estimate near the row count. One row a set."""
    near = F.hll_sketch_estimate("sketch") >= (1 - 4 * ERROR) * F.col("n_rows") - 1
    rows = states.where((F.col("n_rows") > 0) & (F.col("n_full") == F.col("n_rows")) & near)
    return sorted((r["table_name"], tuple(r["columns"])) for r in rows.select("table_name", "columns").collect())


def _confirmed(tables: dict[str, DataFrame], sets: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, tuple[str, ...]]]:
    """The sets without a repeated value: an aggregate each, all in one job."""
    if not sets:
        return []
    checks = [
        tables[t].groupBy(*[_name(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("most")
        ).select(F.lit(i).alias("i"), "most")
        for i, (t, columns) in enumerate(sets)
    ]
    good = {r["i"] for r in union_all(checks).where("most = 1").collect()}
    return [s for i, s in enumerate(sets) if i in good]


def infer_keys(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns) of the smallest keys: single columns of whole numbers or texts
    without nulls or repeats and, for tables where no number is one, pairs of whole numbers.

    Every column is sketched in one scan of its table. Only sets whose estimate comes near
    the row count are counted exactly, so a key is never missed but for four standard errors
    of the sketch, and never reported wrongly.
    """
    single = {
        t: [(f.name,) for f in df.schema.fields if isinstance(f.dataType, KEY_TYPES)] for t, df in tables.items()
    }
    found = _confirmed(tables, _unique(_states(tables, single)))
    numbers = {
        (t, f.name) for t, df in tables.items() for f in df.schema.fields if isinstance(f.dataType, REFERENCE_TYPES)
    }
    keyed = {t for t, columns in found if (t, columns[0]) in numbers}
    keyless = {t: df for t, df in tables.items() if t not in keyed}
    pairs = {
        t: list(combinations([f.name for f in df.schema.fields if isinstance(f.dataType, REFERENCE_TYPES)], 2))
        for t, df in keyless.items()
    }
    if any(pairs.values()):
        found += _confirmed(tables, _unique(_states(keyless, pairs)))
    return spark.createDataFrame(
        [(t, list(columns)) for t, columns in sorted(found)], "table_name string, columns array<string>"
    )


def infer_references(
    spark: SparkSession, tables: dict[str, DataFrame], keys: DataFrame
) -> DataFrame:
    """(from_table, from_col, to_table, to_col): columns of whole numbers whose values all
    stand in a single-column key of the same stem in another table.

    A set that holds another one does not change when that is added, and nor does its sketch.
    So a pair is a candidate where the union of both sketches estimates as the key's own,
    which every true reference does; candidates are confirmed by an anti join of distinct
    values. ``keys`` is what :func:`infer_keys` gives.
    """
    columns = {
        t: [(f.name,) for f in df.schema.fields if isinstance(f.dataType, REFERENCE_TYPES)] for t, df in tables.items()
    }
    states = _states(tables, columns).select("table_name", F.col("columns")[0].alias("column"), "n_full", "sketch")
    stems = F.create_map(*[F.lit(x) for c in {c[0] for cs in columns.values() for c in cs} for x in (c, stem(c))])
    states = states.withColumn("stem", stems[F.col("column")])
    single = keys.where("size(columns) = 1").select("table_name", F.col("columns")[0].alias("column"))
    parents = states.join(single, ["table_name", "column"]).select(
        F.col("table_name").alias("to_table"), F.col("column").alias("to_col"), "stem", F.col("sketch").alias("held")
    )
    children = states.where("n_full > 0").select(
        F.col("table_name").alias("from_table"), F.col("column").alias("from_col"), "stem", "sketch"
    )
    joint, own = (F.hll_sketch_estimate(F.hll_union(x, "held")) for x in ("sketch", "held"))
    near = children.join(parents, "stem").where((F.col("from_table") != F.col("to_table")) & (joint == own))
    pairs = sorted(tuple(r) for r in near.select("from_table", "from_col", "to_table", "to_col").collect())
    schema = "from_table string, from_col string, to_table string, to_col string"
    if not pairs:
        return spark.createDataFrame([], schema)
    checks = []
    for i, (child, c, parent, p) in enumerate(pairs):
        values = tables[child].select(_name(c).cast("long").alias("v")).where("v IS NOT NULL").distinct()
        known = tables[parent].select(_name(p).cast("long").alias("v"))
        checks.append(values.join(known, "v", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n"))
    good = {r["i"] for r in union_all(checks).where("n = 0").collect()}
    return spark.createDataFrame([p for i, p in enumerate(pairs) if i in good], schema)
