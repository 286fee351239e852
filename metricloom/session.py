"""Session settings and lineage control."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any size. Partition counts are left to the cluster: AQE
# coalesces small shuffles and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "metricloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the engine's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, so later readers neither rescan nor lose it.

    Uses the reliable checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where none is named, a local run takes a folder of
    its own; on a cluster the rows are persisted and keep their lineage, which
    survives executor loss by recomputing.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                return df.persist(StorageLevel.MEMORY_AND_DISK)
            folder = tempfile.mkdtemp(prefix="metricloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> str:
    """The folder ``path``, made if it is not there, and deleted when the driver ends."""
    system, where = _file_system(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    system, where = _file_system(spark, path)
    system.delete(where, True)
