"""Table profiles: row counts, nulls, ranges, distinct counts and top values.

A table is scanned twice whatever its width: one aggregate for counts, nulls and
ranges, one frequency count over all its categorical columns together. Text columns are
read once more where a long value is among the frequent ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import redact
from metricloom.schemas import FOREIGN_KEY
from metricloom.session import pin
from metricloom.sources.tables import sample_rows, union_all

# Name fragments that mark a date column whatever its type.
DATE_NAME_HINTS = ("_dt", "dt_", "_at", "_ts", "date", "time", "period", "month", "year")

# Frequent values shown per column, and most distinct values of a dimension,
# all of which a snapshot keeps.
TOP_VALUES = 8
DIMENSION_VALUES = 20

# Longer values are counted by prefix and digest, so their text is not shuffled.
LONG_TEXT = 64

TOP_TYPE = "array<struct<value:string,cnt:bigint>>"


@dataclass
class Snapshot:
    """What is known about a set of tables.

    ``columns`` has one row per column: table_name, ordinal, column_name, type,
    type_class, nullable, primary_key, stat_kind (range, categorical, complex,
    binary), n_rows, n_null, min, max, n_distinct, top_values.
    """

    columns: DataFrame
    foreign_keys: DataFrame
    connection: str = ""
    dialect: str = "spark"
    data: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def tables(self) -> DataFrame:
        """Row and column counts per table."""
        return self.columns.groupBy("table_name").agg(
            F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols")
        )

    def samples(self, spark: SparkSession, n: int = 5) -> DataFrame:
        return sample_rows(spark, self.data, n)


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "complex"
    return "text"


def stat_kind(name: str, kind: T.DataType) -> str:
    """Which statistics a column gets."""
    cls = type_class(kind)
    if cls in ("binary", "complex"):
        return cls
    hinted = any(h in name.lower() for h in DATE_NAME_HINTS)
    return "range" if cls in ("numeric", "date") or hinted else "categorical"


@dataclass(frozen=True)
class _Col:
    col_id: int
    table: str
    ordinal: int
    name: str
    kind: T.DataType
    nullable: bool

    @property
    def ref(self) -> str:
        return "`" + self.name.replace("`", "``") + "`"

    @property
    def stats(self) -> str:
        return stat_kind(self.name, self.kind)


def _plan(tables: dict[str, DataFrame]) -> list[_Col]:
    found = [
        (t, i, f.name, f.dataType, f.nullable)
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return [_Col(n, *rest) for n, rest in enumerate(found)]


def _ranges(df: DataFrame, cols: list[_Col]) -> DataFrame:
    """One scan: rows, nulls, minimum and maximum, turned into a row per column."""
    aggs = ["count(1) AS n"]
    rows = []
    for c in cols:
        n_null, low, high = "NULL", "NULL", "NULL"
        if c.stats != "binary":
            n_null = f"null_{c.col_id}"
            aggs.append(f"count_if({c.ref} IS NULL) AS {n_null}")
        if c.stats == "range":
            low, high = f"min_{c.col_id}", f"max_{c.col_id}"
            aggs.append(f"min({c.ref}) AS {low}")
            aggs.append(f"max({c.ref}) AS {high}")
        rows.append(
            f"named_struct('col_id', {c.col_id}, 'n_rows', n, 'n_null', CAST({n_null} AS bigint), "
            f"'min', CAST({low} AS string), 'max', CAST({high} AS string))"
        )
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")


def _value_key(text: Column) -> Column:
    """Short values stand for themselves; a long one for its first characters and digest."""
    prefix = F.left(text, F.lit(LONG_TEXT))
    return F.when(
        F.length(text) > LONG_TEXT, F.concat(prefix, F.lit("\u0001"), F.sha2(text, 256))
    ).otherwise(text)


def _long_form(df: DataFrame, cols: list[_Col]) -> DataFrame:
    """Columns as (col_id, value) rows; cast to text first, their types differ."""
    cells = [f"named_struct('col_id', {c.col_id}, 'value', CAST({c.ref} AS string))" for c in cols]
    return df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")


def _restore_long(top: DataFrame, tables: dict[str, DataFrame], cols: list[_Col]) -> DataFrame:
    """Replace digests among the top values by the texts they stand for.

    Few keys per column are looked up, and more only where their counts and first
    characters are tied; the join is planned by their size.
    """
    texts = [c for c in cols if isinstance(c.kind, T.StringType)]
    if not texts:
        return top.withColumnRenamed("key", "value")
    wanted = top.where(F.col("key").contains("\u0001")).select("col_id", "key")
    scans = [
        _long_form(tables[t], [c for c in texts if c.table == t]).where(F.length("value") > LONG_TEXT)
        for t in dict.fromkeys(c.table for c in texts)
    ]
    found = (
        union_all(scans)
        .withColumn("key", _value_key(F.col("value")))
        .join(wanted, ["col_id", "key"])
        .groupBy("col_id", "key")
        .agg(F.any_value("value").alias("text"))
    )
    return top.join(found, ["col_id", "key"], "left").select(
        "col_id", "cnt", F.coalesce("text", "key").alias("value")
    )


def _frequencies(
    tables: dict[str, DataFrame], cols: list[_Col], top_k: int
) -> tuple[DataFrame, DataFrame | None]:
    """Distinct counts and top values of all categorical columns, from one count of
    (column, value) pairs. Without ``top_k`` nothing is ranked."""
    used = list(dict.fromkeys(c.table for c in cols))
    pairs = union_all([_long_form(tables[t], [c for c in cols if c.table == t]) for t in used])
    counts = (
        pairs.select("col_id", _value_key(F.col("value")).alias("key"))
        .groupBy("col_id", "key")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # Counting by a condition on cnt keeps that column in the plan, so both readers
    # of the counts share one scan and one shuffle.
    distinct = counts.groupBy("col_id").agg(F.count_if(F.col("cnt") > 0).alias("n_distinct"))
    if not top_k:
        return distinct, None
    # The k-th place by count and first characters, a row a column; keys order like their
    # values up to there. The rank limit is applied before the shuffle as well, so each task
    # sends k rows of a column at most. What reaches that place is a candidate, however many
    # are tied; candidates stay where they are.
    first = F.left("key", F.lit(LONG_TEXT))
    rough = Window.partitionBy("col_id").orderBy(F.desc("cnt"), first)
    places = counts.withColumn("rk", F.row_number().over(rough)).where(F.col("rk") <= top_k)
    last = places.groupBy("col_id").agg(
        F.max_by(F.struct(F.col("cnt").alias("least"), first.alias("upto")), "rk").alias("last")
    )
    near = counts.join(F.broadcast(last), "col_id").where(
        (F.col("cnt") > F.col("last.least")) | ((F.col("cnt") == F.col("last.least")) & (first <= F.col("last.upto")))
    ).drop("last")
    # Whole values settle the ties; the limit again sends k rows a task at most.
    order = Window.partitionBy("col_id").orderBy(F.desc("cnt"), "value")
    top = _restore_long(near, tables, cols).withColumn("rn", F.row_number().over(order))
    top = top.where(F.col("rn") <= top_k)
    ranked = F.array_sort(F.collect_list(F.struct("rn", "value", "cnt")))
    listed = top.groupBy("col_id").agg(
        F.transform(
            ranked, lambda r: F.struct(r["value"].alias("value"), r["cnt"].alias("cnt"))
        ).alias("top_values")
    )
    return distinct, listed


def profile_columns(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]] | None = None,
    top_k: int = TOP_VALUES,
    ranges: bool = True,
    frequencies: bool = True,
) -> DataFrame:
    """Profile of every column of every table; see :class:`Snapshot`. A ``top_k`` of zero
    counts distinct values only."""
    keys = primary_keys or {}
    plan = _plan(tables)
    meta = spark.createDataFrame(
        [
            (
                c.col_id, c.table, c.ordinal, c.name, c.kind.simpleString(), type_class(c.kind),
                c.nullable, c.name in keys.get(c.table, []), c.stats,
            )
            for c in plan
        ],
        "col_id int, table_name string, ordinal int, column_name string, type string, "
        "type_class string, nullable boolean, primary_key boolean, stat_kind string",
    )
    facts = ["n_rows", "n_null", "min", "max", "n_distinct", "top_values"]
    parts = [meta]
    if ranges:
        parts += [_ranges(df, [c for c in plan if c.table == t]) for t, df in tables.items()]
    categorical = [c for c in plan if c.stats == "categorical"]
    if frequencies and categorical:
        parts += [p for p in _frequencies(tables, categorical, top_k) if p is not None]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    for name in facts:
        if name not in merged.columns:
            kind = TOP_TYPE if name == "top_values" else "string" if name in ("min", "max") else "bigint"
            merged = merged.withColumn(name, F.lit(None).cast(kind))
    kept = [c for c in meta.columns if c != "col_id"] + facts
    rows = merged.groupBy("col_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept])
    is_categorical = F.col("stat_kind") == "categorical"
    return (
        rows.withColumn("n_distinct", F.when(is_categorical, F.coalesce("n_distinct", F.lit(0))))
        .withColumn(
            "top_values", F.when(is_categorical, F.coalesce("top_values", F.array().cast(TOP_TYPE)))
        )
        .drop("col_id")
    )


def with_counts(columns: DataFrame) -> DataFrame:
    """Profiles with ``counts``, a map from each listed value to how often it stands there, for
    look-ups; ``top_values`` keeps their order."""
    return columns.withColumn("counts", F.map_from_entries("top_values"))


def foreign_key_rows(spark: SparkSession, keys: list[tuple]) -> DataFrame:
    """Declared foreign keys; those without columns on either side are dropped."""
    rows = spark.createDataFrame(keys, FOREIGN_KEY)
    return rows.where("size(from_cols) > 0 AND size(to_cols) > 0")


def introspect(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]] | None = None,
    foreign_keys: list[tuple] | DataFrame | None = None,
    connection: str = "",
    dialect: str = "spark",
    top_k: int = DIMENSION_VALUES,
    frequencies: bool = True,
) -> Snapshot:
    """Snapshot of ``tables``, with all values of a column that can be a dimension. Without
    ``frequencies`` no value is counted, which table roles do not need. Files carry no constraints, so keys are declared by the
    caller; the password of ``connection`` is masked."""
    declared = foreign_keys if isinstance(foreign_keys, DataFrame) else None
    if declared is None:
        declared = foreign_key_rows(spark, foreign_keys or [])
    masked = spark.range(1).select(redact(F.lit(connection)).alias("c")).first()["c"]
    return Snapshot(
        columns=pin(profile_columns(spark, tables, primary_keys, top_k, frequencies=frequencies)),
        foreign_keys=declared,
        connection=masked,
        dialect=dialect,
        data=tables,
    )


def column_lines(columns: DataFrame) -> DataFrame:
    """One text line per column: type and marks, then its range or most frequent values."""
    marks = F.concat(
        F.when(F.col("primary_key"), ", key").otherwise(""),
        F.when(F.col("nullable"), "").otherwise(", required"),
    )
    often = F.array_join(
        F.transform(
            F.slice("top_values", 1, 5), lambda v: F.concat(v["cnt"].cast("string"), F.lit(" x "), v["value"])
        ),
        "; ",
    )
    nulls = F.concat(F.col("n_null").cast("string"), F.lit(" null"))
    span = F.concat(F.coalesce("min", F.lit("?")), F.lit(" to "), F.coalesce("max", F.lit("?")))
    detail = (
        F.when(F.col("stat_kind") == "binary", "not profiled")
        .when(F.col("stat_kind") == "complex", nulls)
        .when(F.col("stat_kind") == "range", F.concat_ws(" | ", span, nulls))
        .otherwise(
            F.concat_ws(" | ", F.concat(F.col("n_distinct").cast("string"), F.lit(" values")), often, nulls)
        )
    )
    line = F.concat("column_name", F.lit(" ("), "type", marks, F.lit("): "), detail)
    return columns.select("table_name", "ordinal", line.alias("line"))


def snapshot_lines(snapshot: Snapshot) -> DataFrame:
    """All lines of a snapshot, per table in order: title, columns, foreign keys."""
    title = F.concat(F.lit("# "), "table_name", F.lit(", "), F.col("n_rows").cast("string"), F.lit(" rows"))
    titles = snapshot.tables.select(
        "table_name", F.lit(0).alias("section"), F.lit(0).alias("pos"), title.alias("line")
    )
    body = column_lines(snapshot.columns).select(
        "table_name", F.lit(1).alias("section"), F.col("ordinal").alias("pos"), "line"
    )
    link = F.concat(
        F.array_join("from_cols", ", "), F.lit(" refers to "), "to_table", F.lit(" by "), F.array_join("to_cols", ", ")
    )
    links = snapshot.foreign_keys.select(
        F.col("from_table").alias("table_name"), F.lit(2).alias("section"), F.lit(0).alias("pos"),
        link.alias("line"),
    )
    return titles.unionByName(body).unionByName(links)


def render_as_text(spark: SparkSession, snapshot: Snapshot) -> str:
    """Whole snapshot as text. Its size depends on the number of columns, not on rows."""
    from metricloom.operators.dimensions import dimension_manifest, manifest_lines

    parts = [f"Source {snapshot.connection} ({snapshot.dialect})", ""]
    dims = [
        r["line"]
        for r in manifest_lines(dimension_manifest(snapshot)).orderBy("table_name", "ordinal").collect()
    ]
    if dims:
        parts += ["# Dimensions", *dims, ""]
    first = {r["table_name"]: r["row_json"] for r in snapshot.samples(spark, 1).collect()}
    lines = snapshot_lines(snapshot).orderBy("table_name", "section", "pos", "line").collect()
    for table in dict.fromkeys(r["table_name"] for r in lines):
        parts += [r["line"] for r in lines if r["table_name"] == table]
        if table in first:
            parts.append(f"for example {first[table]}")
        parts.append("")
    return "\n".join(parts)
