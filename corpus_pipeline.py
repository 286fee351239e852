"""A training corpus from raw documents: five stages, each written and read again.

Each stage takes (session, documents, folder of the tables) and works on all that the stage
before it kept. ``ORACLE_SQL`` is None: SQL can express neither ranking nor sampling.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, lattice, line_dedup, quality, simhash
from metricloom.llm.common import table
from metricloom.session import remove, until_exit


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score reaches the ranking's cut; the ranking is learned on them.

    Null and empty texts get the score of an empty text, repeated rows theirs each; without
    labels every document stays. No documents give none; other columns come along.
    """
    model = quality.train(docs, table(spark, folder, "labels"))
    kept = quality.score_documents(docs, model).where("keep")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that a document before them has.

    A null text becomes an empty one, ``n_chars`` the new length; repeated rows of one id keep
    their lines, which no other id holds. No documents give none.
    """
    del spark, folder
    found = line_dedup.dedup_lines(docs)
    text = F.col("text")
    own = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that SimHash links, by its operator's shingles and radius.

    The least id stays. Null and empty texts have one fingerprint and form a group; repeated
    rows leave one; no documents give none; other columns come along as they are.
    """
    del spark, folder
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; no documents, or no
    items, leave the documents as they are. Other columns come along.
    """
    return decontaminate.drop_leaks(docs, table(spark, folder, "benchmark"))


def sample_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled segmentations of each document into pieces: the documents' columns but the
    text, then sample, ids, log_prob, log_inclusion and restored.

    A null or empty text has one segmentation without ids; repeated rows are sampled alike;
    no documents give no rows.
    """
    del spark, folder
    return lattice.encode_samples(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("lines", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pieces", sample_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages go through Parquet in the shared checkpoint folder;
    a local session without one takes a folder of its own. A stage's table goes when the next
    one is written, the last one when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = until_exit(spark, path)
    return docs
