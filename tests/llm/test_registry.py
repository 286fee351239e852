import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from metricloom.llm import decontaminate, lattice, line_dedup, quality, registry, simhash
from metricloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def test_all_are_registered():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())


def test_contracts(spark):
    n = table(spark, FOLDER, "documents").count()
    for name in ("op1_quality_classifier", "op2_secret_scan", "op3_simhash", "op7_personal_data", "op9_sharding"):
        rows = registry.QUERIES[name](spark, FOLDER)
        assert rows.select("doc_id").distinct().count() == rows.count() == n
    found = registry.QUERIES["op5_nearest_neighbours"](spark, FOLDER)
    asked = table(spark, FOLDER, "embeddings").where("vec_id % 20 = 0").count()
    assert found.count() == 20 * asked
    pages = registry.QUERIES["op8_html_text"](spark, FOLDER)
    assert pages.count() == table(spark, FOLDER, "pages").count()
    assert pages.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = registry.QUERIES["op10_piece_sampling"](spark, FOLDER)
    assert pieces.where("NOT restored").count() == 0
    assert pieces.groupBy("doc_id", "ids_hash").count().where("count > 1").count() == 0


def test_pipeline_is_its_stages(spark):
    """The whole run equals the operators one after the other, and clean documents stay."""
    docs = table(spark, FOLDER, "documents")
    got = corpus_pipeline.run(spark, FOLDER).collect()
    model = quality.train(docs, table(spark, FOLDER, "labels"))
    one = quality.score_documents(docs, model).where("keep").select(*docs.columns)
    labels = table(spark, FOLDER, "labels")
    kept = one.join(labels, "doc_id").where("quality = 1").count()
    assert kept >= 0.97 * docs.join(labels, "doc_id").where("quality = 1").count()
    two = line_dedup.dedup_lines(one).drop("n_lines", "n_dropped")
    groups = simhash.near_duplicates(two).groupBy("component_id").count().count()
    three = simhash.keep_one(two)
    assert three.count() == groups
    leaks = decontaminate.find_leaks(three, table(spark, FOLDER, "benchmark"))
    four = three.join(leaks, "doc_id", "left_anti")
    want = lattice.encode_samples(four.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in got) == sorted(
        (r["doc_id"], r["sample"], tuple(r["ids"])) for r in want
    )
    assert all(math.isfinite(r["log_prob"]) for r in got)


def test_stages_stand_empty_and_repeated_documents(spark):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(0).union(
        spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "", None, None, 0)], docs.schema)
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs.limit(0), odd):
            assert stage(spark, rows, FOLDER).columns == docs.columns
            stage(spark, rows, FOLDER).collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0
