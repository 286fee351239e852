import random

import pytest

from metricloom.operators import broker, similar_names
from tests.test_serving import best_by_force


def name(rng, words):
    return rng.choice([" ", "_"]).join(rng.choice(words) for _ in range(rng.randrange(1, 6)))


def worded(text):
    return set(text.lower().strip().replace("_", " ").split())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_names_by_force(spark, seed):
    rng = random.Random(seed)
    words = ["total", "monthly", "of", "revenue", "revenues", "cost", "a", "ab", "abc", "visits", "zz", "été"]
    names = sorted({name(rng, words) for _ in range(60)} | {"", "x", "Total Cost", "total cost", "  "})
    rng.shuffle(names)
    asked = [name(rng, words) for _ in range(60)]
    asked += ["".join(rng.sample(n, len(n))) if rng.random() < 0.3 else n[1:] + rng.choice("xyz ") for n in names]
    asked += ["", " ", "revnue", "TOTAL_COST", "monthlyrevenue", "mothly revenues of"]
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos bigint")
    got = broker.match_names(spark.createDataFrame([(r,) for r in asked], "request string"), listed).collect()
    assert len(got) == len(asked)
    for r in got:
        want, score = best_by_force(r["request"], names)
        assert (r["matched_name"], round(r["score"], 9)) == (want, round(score, 9)), r["request"]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_all_pairs_by_words(spark, least):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)] + ["all"] * 6
    names = sorted({name(rng, words) for _ in range(80)})
    asked = sorted({name(rng, words) for _ in range(80)})
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos bigint")
    got = similar_names.similar_by_words(spark.createDataFrame([(r,) for r in asked], "request string"), listed, least)
    want = set()
    for r in asked:
        for n in names:
            both, either = len(worded(r) & worded(n)), len(worded(r) | worded(n))
            if both / either >= least - 1e-9:
                want.add((r.strip(), n, both))
    rows = got.collect()
    assert {(r["request"], r["name"], r["shared"]) for r in rows} == want and len(rows) == len(want)


def test_common_words_alone_make_no_pairs(spark):
    """Names that share a frequent word only are never joined above a similarity."""
    names = spark.range(300).selectExpr("concat('total orders of customer', id) AS name", "id AS pos")
    asked = spark.range(300).selectExpr("concat('total orders by ', 'customer', id) AS request")
    a, k = similar_names._distinct(asked, names, None)
    a, k = similar_names.order_members(a, k)
    from pyspark.sql import functions as F

    pairs = similar_names.joined(a.withColumn("least", F.lit(0.6)), k, "words", 0.6)
    assert pairs.count() == 300


def test_empty_sides(spark):
    names = spark.createDataFrame([], "name string, pos bigint")
    asked = spark.createDataFrame([("a",)], "request string")
    assert [tuple(r) for r in broker.match_names(asked, names).collect()] == [("a", None, 0.0)]
    assert broker.match_names(asked.limit(0), names).count() == 0
    assert similar_names.similar_by_words(asked, names, 0.5).count() == 0
