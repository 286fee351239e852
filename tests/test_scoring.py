import random

import pytest
from pyspark.sql import functions as F

from metricloom.operators import scoring
from metricloom.operators.skew import attach, keep_first, rank_rounded, upper_median


def test_attach_equals_a_left_join(spark):
    rng = random.Random(3)
    keys = ["hot"] * 400 + [f"k{rng.randrange(60)}" for _ in range(300)] + [None] * 20 + ["lost"] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id bigint, k string")
    counted = {}
    for k in keys:
        if k not in (None, "lost"):
            counted[k] = counted.get(k, 0) + 1
    lookup = spark.createDataFrame([(k, n, f"v-{k}") for k, n in counted.items()], "k string, n bigint, v string")
    got = {r["id"]: r["v"] for r in attach(rows, lookup, "k", ["v"], "n", hot_rows=100).collect()}
    assert len(got) == len(keys)
    assert got == {i: f"v-{k}" if k in counted else None for i, k in enumerate(keys)}


def test_equal_rows_of_a_hot_key_stay_where_they_are(spark):
    rows = spark.range(0, 40_000, 1, 16).selectExpr("'hot' AS k", "7 AS x")
    lookup = spark.createDataFrame([("hot", 40_000, "v"), ("cold", 1, "w")], "k string, n bigint, v string")
    found = attach(rows, lookup, "k", ["v"], "n")
    sizes = found.where("v = 'v'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 40_000 and max(r["count"] for r in sizes) <= 2_500


def test_upper_median_equals_sorting(spark):
    rng = random.Random(5)
    groups = {
        "one": [7],
        "even": [4, 1, 3, 2],
        "zeros": [0, 0, 0, 5],
        "wide": [rng.randrange(10**12) for _ in range(501)],
        "narrow": [10**9 + rng.randrange(50) for _ in range(400)],
        "ties": [3] * 50 + [4] * 50,
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    got = {r["g"]: r["m"] for r in upper_median(rows, ["g"], "v", "m").collect()}
    assert got == {g: float(sorted(vs)[len(vs) // 2]) for g, vs in groups.items()}


def test_ranks(spark):
    rows = spark.createDataFrame(
        [("a", "x", 9.5), ("a", "y", 9.5), ("a", "z", 1.0), ("a", "w", None), ("b", "x", -3.0), ("b", "y", 0.0)],
        "g string, n string, s double",
    )
    got = {(r["g"], r["n"]): r["rank"] for r in rank_rounded(rows, ["g"], "s").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("a", "z"): 3, ("a", "w"): 4, ("b", "y"): 1, ("b", "x"): 2}


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, p int, v string")
    assert {r["v"] for r in keep_first(rows, ["k"], ["p"]).collect()} == {"early", "only"}


def plain_scores(metrics, facts, n_covered, n_tables, judged):
    """The score formula over plain lists."""
    n = len(metrics)
    count = {s: sum(m["status"] == s for m in metrics) for s in ("PASS", "WARN", "FAIL")}
    dup = sum(bool(m["duplicate_of"]) for m in metrics)
    const = sum("constant_values" in m["error"] for m in metrics)
    good = sorted(m["n_rows"] for m in metrics if m["sql_ok"])
    spans = []
    for m in metrics:
        try:
            (sy, sm), (ey, em) = ((int(m[k][:4]), int(m[k][5:7])) for k in ("start", "end"))
            spans.append((ey - sy) * 12 + em - sm)
        except ValueError:
            pass
    composite = count["PASS"] / n * (n_covered / n_tables) * (1 - (dup + const) / n) * 100
    mean = round(sum(judged) / len(judged), 2) if judged else None
    return {
        "n_metrics": n,
        "n_pass": count["PASS"],
        "n_warn": count["WARN"],
        "n_fail": count["FAIL"],
        "n_duplicates": dup,
        "n_constants": const,
        "n_facts": len(facts),
        "n_facts_pass": sum(f == "PASS" for f in facts),
        "noise_ratio": (dup + const) / n,
        "conf_rate": sum(m["confidence"] == "high" for m in metrics) / n,
        "date_ok_rate": sum(m["sql_ok"] and m["date_range_ok"] for m in metrics) / n,
        "median_rows": float(good[len(good) // 2]) if good else 0.0,
        "avg_span_months": sum(spans) / len(spans) if spans else 0.0,
        "composite": composite,
        "semantic_score": mean,
        "combined": composite * mean / 5 if judged else None,
    }


@pytest.mark.parametrize("seed", range(2))
def test_scores_of_random_catalogues(spark, seed):
    rng = random.Random(seed)
    metrics, facts, covered, judged = {}, {}, {}, {}
    for c in ("c1", "c2", "c3"):
        metrics[c] = [
            {
                "status": rng.choice(["PASS", "PASS", "WARN", "FAIL"]),
                "error": rng.choice(["", "sparse", "constant_values", "sparse, constant_values"]),
                "duplicate_of": rng.choice(["", "", "m0"]),
                "confidence": rng.choice(["high", "low"]),
                "sql_ok": rng.random() < 0.8,
                "date_range_ok": rng.random() < 0.5,
                "n_rows": rng.randrange(500),
                "start": rng.choice(["2020-01-01", "", "2019", "2018-07-01"]),
                "end": rng.choice(["2024-01-01", "", "2021-12-31"]),
            }
            for _ in range(rng.randrange(1, 30))
        ]
        facts[c] = [rng.choice(["PASS", "WARN"]) for _ in range(rng.randrange(4))]
        covered[c] = rng.randrange(8)
        judged[c] = [rng.randrange(1, 6) for _ in range(rng.choice([0, 3]))]
    results = spark.createDataFrame(
        [(c, m["status"], m["error"], m["duplicate_of"], m["confidence"], m["sql_ok"], m["date_range_ok"], m["n_rows"])
         for c, ms in metrics.items() for m in ms],
        "catalogue_id string, status string, error string, duplicate_of string, confidence string, sql_ok boolean, "
        "date_range_ok boolean, n_rows bigint",
    )
    entries = spark.createDataFrame(
        [(c, (m["start"], m["end"]), ["a", "b"]) for c, ms in metrics.items() for m in ms],
        "catalogue_id string, time_range struct<start:string,end:string>, tables_used array<string>",
    )
    fact_rows = spark.createDataFrame(
        [(c, s) for c, fs in facts.items() for s in fs] or [("none", "PASS")], "catalogue_id string, status string"
    )
    ids = spark.createDataFrame([(c, f"model-{c}", 1, "db") for c in metrics], "catalogue_id string, label string, run_index int, db_stem string")
    cover = spark.createDataFrame(list(covered.items()), "catalogue_id string, n_covered_tables bigint")
    scores = spark.createDataFrame(
        [(c, f"m{i}", float(s)) for c, js in judged.items() for i, s in enumerate(js)] or [("none", "m", 1.0)],
        "catalogue_id string, name string, score double",
    )
    got = {
        r["catalogue_id"]: r
        for r in scoring.catalogue_scores(ids, entries, results, fact_rows, cover, 8, scores).collect()
    }
    for c in metrics:
        expected = plain_scores(metrics[c], facts[c], covered[c], 8, judged[c])
        for name, value in expected.items():
            tolerance = {"composite": 0.051, "combined": 0.051, "avg_span_months": 0.051}.get(name, 6e-5)
            if value is None:
                assert got[c][name] is None, name
            else:
                assert got[c][name] == pytest.approx(value, abs=tolerance), (c, name)


def test_model_ranking_uses_combined_when_judged(spark):
    scores = spark.createDataFrame(
        [("a", 80.0, 2.0, 32.0), ("a", 60.0, None, None), ("b", 50.0, 5.0, 50.0)],
        "label string, composite double, semantic_score double, combined double",
    )
    got = {r["label"]: (r["n_dbs"], r["score"], r["combined"], r["rank"]) for r in scoring.model_ranking(scores).collect()}
    assert got == {"a": (2, 70.0, 32.0, 2), "b": (1, 50.0, 50.0, 1)}
