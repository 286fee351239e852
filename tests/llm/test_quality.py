import numpy as np
from pyspark.sql import functions as F

from metricloom.llm import quality
from tests.llm.support import hard_docs, hard_texts


def make(spark, n=400):
    rng = np.random.default_rng(1)
    words = ["stone", "river", "light", "walks", "under", "green", "table", "often", "seven", "house"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 30)) + "."
        if i % 3 == 0:
            text = " ".join(["junk!!"] * 30) if i % 2 else text.upper() + " ### $$$"
        docs.append((i, text))
        labels.append((i, int(i % 3 != 0), 0))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = make(spark)
    model = quality.train(docs, labels)
    rows = (
        quality.score_documents(docs, model)
        .join(labels, "doc_id")
        .where(quality.held_out(F.col("doc_id")))
        .select("keep", "quality", "score")
        .collect()
    )
    assert len(rows) > 40
    assert np.mean([r["keep"] == bool(r["quality"]) for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == r["keep"] for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels = make(spark, 120)
    flipped = labels.withColumn(
        "quality",
        F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    assert quality.train(docs, labels) == quality.train(docs, flipped)


def test_pairs_agree_with_gradient(spark):
    """Newton's fit is where the penalised pair loss has no slope."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    model = quality.fit(x, y)
    f = model.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    better = np.concatenate([np.repeat(good, 8), draw.choice(good, len(bad) * 8)])
    worse = np.concatenate([draw.choice(bad, len(good) * 8), np.repeat(bad, 8)])
    d, w = f[better] - f[worse], np.array(model.weights)
    slope = d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.PENALTY * w
    assert np.abs(slope).max() < 1e-4


def test_hard_cases(spark):
    docs, labels = make(spark, 90)
    hard = hard_docs(spark, hard_texts())
    found = quality.score_documents(hard, quality.train(docs, labels))
    assert found.columns == ["doc_id", "text", "lang", "_row", "a.b", "k0", "score", "keep"]
    rows = found.collect()
    assert len(rows) == len(hard_texts()) and all(r["score"] is not None for r in rows)
    empty = {round(r["score"], 12) for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1


def test_labels_that_cannot_teach(spark):
    docs, labels = make(spark, 60)
    for some in (labels.limit(0), labels.where("quality = 1")):
        kept = quality.score_documents(docs, quality.train(docs, some))
        assert kept.where("keep").count() == 60
    nulls = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    assert quality.train(docs, nulls.union(labels)) == quality.train(docs, labels)
    assert quality.score_documents(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
