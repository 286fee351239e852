"""Calls per minute over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.skew import keep_first
from metricloom.operators.usage import calls_per_minute


def stream_calls_per_minute(calls: DataFrame, keys: list[str], delay: str = "2 minutes") -> DataFrame:
    """Tumbling minute counts; calls later than ``delay`` behind the newest are dropped."""
    return calls.withWatermark("ts", delay).transform(calls_per_minute, keys)


def run_to_files(counts: DataFrame, folder: str, checkpoint: str) -> None:
    """Drain a stream of running counts into ``folder``. Each micro-batch owns a
    sub-folder and overwrites it on retry, so a repeated batch leaves no double rows."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{folder}/batch_{batch_id}"
        )

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Final count of each minute: its last update wins."""
    updates = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return keep_first(updates, [*keys, "minute"], [F.desc("batch_id")]).drop("batch_id")
