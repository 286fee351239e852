"""Distinct counts that grow with their files: a mergeable sketch of every column of a file.

A file is read once in its life. Its states are kept in a store; the counts of a table are
the union of those of its present files, so a second profile reads only new files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.profile import type_class
from metricloom.sources.tables import union_all

#: Binary logarithm of a sketch's registers.
LG_K = 12
#: Relative standard error of an estimate with so many registers, 1.04 / sqrt(2 ** LG_K).
ERROR = 1.04 / 2 ** (LG_K / 2)

STATE = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_null", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _file_key(meta: Column) -> Column:
    """A file that is written anew counts as another one."""
    return F.concat_ws(
        "|", meta["file_path"], meta["file_size"], F.unix_micros(meta["file_modification_time"])
    )


def present_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, path, file) of the files at hand, from a listing; no file is opened."""
    listed = [
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.lit(table).alias("table_name"),
            F.col("_metadata.file_path").alias("path"),
            _file_key(F.col("_metadata")).alias("file"),
        )
        for table, path in paths.items()
    ]
    return union_all(listed)


def file_states(df: DataFrame, table: str) -> DataFrame:
    """States (:data:`STATE`) of every file that ``df`` reads, from one scan: each column is
    sketched where it lies, and a task sends one state a file and column."""
    cols = [f for f in df.schema.fields if type_class(f.dataType) not in ("binary", "complex")]
    meta = df.select("_metadata", *[F.col(f"`{f.name}`") for f in cols]).withColumn("_file", _file_key(F.col("_metadata")))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(cols):
        value = F.col(f"`{f.name}`")
        aggs += [F.count(value).alias(f"_n{i}"), F.hll_sketch_agg(value.cast("string"), LG_K).alias(f"_s{i}")]
    states = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("n_null"),
                F.col(f"_s{i}").alias("sketch"),
            )
            for i, f in enumerate(cols)
        ]
    )
    wide = meta.groupBy("_file").agg(*aggs)
    return wide.select(
        F.lit(table).alias("table_name"), F.col("_file").alias("file"), F.col("_rows").alias("n_rows"),
        F.inline(states),
    ).select(*STATE.fieldNames())


def stored(spark: SparkSession, store: str) -> DataFrame:
    """States kept so far; none where the store does not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(STATE).parquet(store) if system.exists(path) else spark.createDataFrame([], STATE)


def update(spark: SparkSession, paths: dict[str, str], store: str) -> list[str]:
    """Add the states of files that the store does not know; returns the files read.

    ``paths`` are the tables' parquet files or folders. An append is one commit a table, and
    states of a file that a failed run left twice are merged to the same result.
    """
    known = stored(spark, store).select("table_name", "file").distinct()
    new = present_files(spark, paths).join(known, ["table_name", "file"], "left_anti")
    todo: dict[str, list[str]] = {}
    for row in new.select("table_name", "path").toLocalIterator():
        todo.setdefault(row["table_name"], []).append(row["path"])
    for table, files in todo.items():
        file_states(spark.read.parquet(*files), table).write.mode("append").parquet(store)
    return [f for files in todo.values() for f in files]


def estimates(spark: SparkSession, store: str, paths: dict[str, str]) -> DataFrame:
    """(table_name, column_name, n_rows, n_null, n_distinct) over the files at hand; states of
    files that are gone do not count. ``n_distinct`` is an estimate, see :data:`ERROR`."""
    present = present_files(spark, paths).select("table_name", "file")
    states = stored(spark, store).dropDuplicates(["table_name", "file", "column_name"])
    return (
        states.join(present, ["table_name", "file"], "left_semi")
        .groupBy("table_name", "column_name")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_null").alias("n_null"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
        )
    )
