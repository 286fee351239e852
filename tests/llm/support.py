"""Small documents with the cases every operator has to stand."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, `_row` string, score string, `a.b` int, k0 int"


def hard_docs(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with columns whose names clash with those the operators use."""
    rows = [(i, t, None, "r", "own", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def hard_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(f"word{i % 977} number {i}" for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "A plain sentence of some words stands here."),
        (4, "A plain sentence of some words stands here."),
        (5, "A plain sentence of some words stands here."),
        (None, "Without an identifier this one comes along."),
        (None, None),
        (6, long),
        (7, "Überall ñandú \U0001f642 in text ▁ \0 end"),
        (-8, "x"),
    ]
