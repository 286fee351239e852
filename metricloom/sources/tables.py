"""Read-only table sources, key checks and query previews."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import is_select, strip_line_comments, truncate


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Data files directly inside ``folder``, sorted, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in system.listStatus(path)]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(suffix)]


def open_folder(
    spark: SparkSession, folder: str, fmt: str = "parquet", names: list[str] | None = None
) -> dict[str, DataFrame]:
    """One DataFrame per data file (or table folder) in ``folder``, named by its stem.

    With ``names`` given only those are opened and the folder is not listed.
    """
    suffix = f".{fmt}"
    root = folder.rstrip("/")
    paths = [f"{root}/{n}{suffix}" for n in names] if names else list_files(spark, folder, suffix)
    return {p.rsplit("/", 1)[-1].removesuffix(suffix): spark.read.format(fmt).load(p) for p in paths}


def open_jdbc(spark: SparkSession, url: str, tables: list[str], **options: str) -> dict[str, DataFrame]:
    """Tables of a JDBC database. Pass ``partitionColumn``, bounds and
    ``numPartitions`` to read one in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return {t: reader.option("dbtable", t).load() for t in tables}


def open_catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Tables and views the session's catalog lists."""
    listed = spark.catalog.listTables(database)
    return {
        t.name: spark.table(t.name if t.isTemporary or not database else f"{database}.{t.name}")
        for t in sorted(listed, key=lambda t: t.name)
    }


def register(tables: dict[str, DataFrame]) -> None:
    """Make every table visible to SQL text under its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Result of one stored statement, lazily. Wrapping keeps it to a query: a
    statement with side effects does not parse inside the brackets."""
    return spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';').strip()}\n)")


def _label(name: str) -> Column:
    return F.lit(name).alias("table_name")


def table_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: position, name, type text, nullability."""
    rows = [
        (t, i, f.name, f.dataType.simpleString(), f.nullable)
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, type string, nullable boolean"
    )


def schema_lines(columns: DataFrame) -> DataFrame:
    """One ``table(col, col)`` line per table, columns in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    names = F.array_join(F.transform(ordered, lambda c: c["column_name"]), ", ")
    return columns.groupBy("table_name").agg(
        F.concat("table_name", F.lit("("), names, F.lit(")")).alias("line")
    )


def key_check(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Whether ``keys`` identify the rows: row, distinct-key and null-key counts."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    groups = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(~has_null).alias("n_distinct"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("n_null_keys"),
    ).select(
        _label(name),
        F.lit(",".join(keys)).alias("key_columns"),
        "n_rows",
        "n_distinct",
        "n_null_keys",
        ((F.col("n_rows") == F.col("n_distinct")) & (F.col("n_null_keys") == 0)).alias("is_key"),
    )


def foreign_key_check(
    child: DataFrame, child_name: str, child_cols: list[str], parent: DataFrame, parent_name: str, parent_cols: list[str]
) -> DataFrame:
    """Child rows whose key is missing from the parent. Keys are counted before the
    join, so a frequent key crosses the network once per task."""
    keys = [f"k{i}" for i in range(len(child_cols))]
    used = (
        child.select(*[F.col(c).alias(k) for c, k in zip(child_cols, keys)])
        .dropna()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = parent.select(*[F.col(c).alias(k) for c, k in zip(parent_cols, keys)])
    missing = used.join(known, keys, "left_anti")
    return missing.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
        F.count(F.lit(1)).alias("orphan_keys"),
    ).select(
        F.lit(child_name).alias("from_table"),
        F.lit(",".join(child_cols)).alias("from_cols"),
        F.lit(parent_name).alias("to_table"),
        "orphan_rows",
        "orphan_keys",
    )


def sample_rows(
    spark: SparkSession, tables: dict[str, DataFrame], n: int = 5, order: dict[str, list[str]] | None = None
) -> DataFrame:
    """First ``n`` rows of each table as JSON text, binary values masked.

    With ``order``, the columns to sort a table by, the first are those by these columns, by a
    top-n that sends ``n`` rows a task. Without it a table is read by ``take``, which stops
    at the first partitions that hold ``n`` rows.
    """
    rows = []
    for name, df in tables.items():
        shown = [
            F.when(F.col(f"`{f.name}`").isNotNull(), F.lit("<binary>")).alias(f.name)
            if isinstance(f.dataType, T.BinaryType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
        row = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row_json")
        by = [F.col(f"`{c}`") for c in (order or {}).get(name, [])]
        # Narrow to the first rows before any text is made of them.
        first = df.orderBy(*by).limit(n) if by else df
        taken = first.select(row, *[c.alias(f"_by{i}") for i, c in enumerate(by)])
        if by:
            taken = taken.orderBy(*[f"_by{i}" for i in range(len(by))])
        rows += [(name, i, r["row_json"]) for i, r in enumerate(taken.take(n))]
    return spark.createDataFrame(rows, "table_name string, pos int, row_json string")


def preview(spark: SparkSession, sql: str, max_rows: int = 5, max_chars: int = 500) -> DataFrame:
    """One row holding the text of a query's first rows, or why there is none."""
    clean = spark.range(1).select(
        is_select(F.lit(sql)).alias("ok"), strip_line_comments(F.lit(sql)).alias("sql")
    ).first()

    def answer(text: Column | str) -> DataFrame:
        shown = F.lit(text) if isinstance(text, str) else text
        return spark.range(1).select(shown.alias("result"))

    if not clean["ok"]:
        return answer("ERROR: Only SELECT queries are allowed.")
    try:
        df = run_sql(spark, clean["sql"])
        names = df.columns
        cells = df.toDF(*[f"c{i}" for i in range(len(names))])
        line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cells.columns])
        lines = [r["line"] for r in cells.select(line.alias("line")).take(max_rows)]
    except PySparkException as error:
        return answer(f"ERROR: {error}")
    if not lines:
        return answer("Query returned 0 rows.")
    head = " | ".join(names)
    body = "\n".join([head, "-" * max(len(head), 10), *lines])
    if len(lines) == max_rows:
        body += f"\n(truncated to {max_rows} rows)"
    return answer(truncate(F.lit(body), max_chars, "\n... (truncated)"))
