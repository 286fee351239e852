import numpy as np
from pyspark.sql import functions as F

from metricloom.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def exact(vectors, query, k):
    scored = [
        (-float((np.asarray(v, dtype=np.float64) * np.asarray(vectors[query], dtype=np.float64)).sum()), i)
        for i, v in vectors.items()
        if i != query and len(v) == len(vectors[query])
    ]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own") for i, v in rows], SCHEMA).repartition(4)


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(3000, 32)).astype(np.float32)
    data *= rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    vectors = {i: data[i].tolist() for i in range(3000)}
    found = nearest(frame(spark, vectors.items()), F.col("vec_id") % 100 == 0, k=20, block=700, group=16)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, rows in got.items():
        want = exact(vectors, q, 20)
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        for _, i, s in rows:
            assert abs(s - np.dot(np.float64(data[i]), np.float64(data[q]))) < 1e-9
        hits += len({i for _, i, _ in rows} & {i for i, _ in want})
    assert hits >= 0.9 * 20 * len(got)


def test_hard_cases(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]),
        (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (10, [-1.0, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [2.0, 0.0]),
    ]
    found = nearest(frame(spark, rows), F.lit(True), k=4).collect()
    got = {}
    for r in sorted(found):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(12, 2.0), (1, 1.0), (2, 1.0), (3, 0.0)]
    assert got[12] == [(0, 2.0), (1, 2.0), (2, 2.0), (3, 0.0)]
    assert sorted(got) == [0, 1, 2, 3, 10, 12]  # 11 has no other of its length
    assert nearest(frame(spark, rows).limit(0), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(600)] + [(1000, [1.0, 0.0, 0.0])]
    found = nearest(frame(spark, rows), F.col("vec_id") == 40, k=5, block=100).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]
