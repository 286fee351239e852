"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.session import pin, until_exit

# The white space of the contracts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pack(df: DataFrame, outputs: list[str]) -> tuple[Column, list[str]]:
    """One struct of the input's columns that no output replaces, and their names.

    Packed, no name of the input can clash with those an operator uses inside. Names count
    as equal if they differ in case only.
    """
    taken = {x.lower() for x in outputs}
    names = [c for c in df.columns if c.lower() not in taken]
    filler = "_" * (1 + max(map(len, df.columns), default=0))
    return F.struct(F.lit(True).alias(filler), *[F.col(f"`{c}`") for c in names]), names


def unpack(names: list[str], row: str = "_row") -> list[Column]:
    return [F.col(row)[c].alias(c) for c in names]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Only texts with other letters take the slow way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(*values: Column) -> list[Column]:
    """128 bits that stand for the values in shuffles: two longs."""
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder, and read from there.

    Columns compress and later readers skip those they don't need, which suits wide rows
    better than a checkpoint. The table goes when the driver ends. Without a folder, the rows
    are kept as ``pin`` does.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return pin(df)
    path = f"{folder.rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
