"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import (
    conversations,
    decontaminate,
    html_text,
    lattice,
    line_dedup,
    merkle,
    neighbours,
    packing,
    pii,
    quality,
    secret_scan,
    shards,
    simhash,
)
from metricloom.llm.common import table

SHARDS = 40


def _hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.col("keep").cast("int").alias("predicted"),
    )


def _joined(spans):
    """kind:start:end of each span, by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # Found spans meet no base span, so the starts alone put them in between.
    ordered = F.array_sort(
        F.concat("base", "found"), lambda a, b: F.when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .otherwise(_rank(a) - _rank(b)),
    )
    return secret_scan.scan_secrets(docs).select(
        "doc_id",
        *[_count(k) for k in secret_scan.BASE_KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(ordered).alias("spans"),
    )


def _rank(span):
    kinds = F.array(*map(F.lit, secret_scan.BASE_KINDS))
    return F.array_position(kinds, span["kind"]).cast("int")


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs).select(
        "doc_id",
        *[_count(k) for k in pii.BASE_KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "found")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    ties = [F.col("size"), F.col("text_crc32")]
    return shards.assign_shards(docs, SHARDS, ties=ties).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lattice.encode_samples(docs).select(
        "doc_id",
        "sample",
        F.size("ids").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        "log_prob",
        "log_inclusion",
        "restored",
    )


def _crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = packing.pack_documents(docs, derive={"length": len, "ids_crc32": _crc32})
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows, present = conversations.damage(table(spark, folder, "conversations"))
    found = conversations.repair(rows, present=present)
    hashes = conversations.line_hashes(found.rows).select(F.col("conv_id").alias("_id"), "sha256")
    return found.report.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        *found.report.columns,
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    # Tampering takes the line ends out of every second text.
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    start = merkle.entry_hash([*map(F.col, columns[:-1]), text])
    manifest = merkle.build(docs, columns, start=start)
    root = F.lit(manifest.root).cast("string")
    return merkle.climb(spark, manifest).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


QUERIES = {
    q.__name__: q
    for q in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_simhash,
        op4_line_dedup,
        op5_nearest_neighbours,
        op6_decontamination,
        op7_personal_data,
        op8_html_text,
        op9_sharding,
        op10_piece_sampling,
        op11_packing,
        op12_conversation_repair,
        op13_merkle_manifest,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE = {
    "op4_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
),
l AS (
  SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM d
),
n AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM l
),
s AS (
  SELECT k, min(doc_id) AS first FROM n WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT n.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE s.first IS NOT NULL AND n.doc_id <> s.first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
    FILTER (WHERE s.first IS NULL OR n.doc_id = s.first), '')) AS kept_sha256
FROM n LEFT JOIN s ON n.k = s.k
GROUP BY n.r, n.doc_id
""",
}
