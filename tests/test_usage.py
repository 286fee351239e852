import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metricloom.operators import metrics, querylog, usage
from metricloom.schemas import PRICE_BOOK
from metricloom.streaming import calls as stream

START = dt.datetime(2024, 1, 1)


def call(session, second, tokens=1, model="m"):
    return (session, START + dt.timedelta(seconds=second), model, 1000, tokens, 0, 0)


CALLS = (
    "session string, ts timestamp, model string, input_tokens bigint, output_tokens bigint, "
    "cache_write_tokens bigint, cache_read_tokens bigint"
)


def trailing(spark, rows, **kw):
    got = usage.trailing_tokens(spark.createDataFrame(rows, CALLS), **kw).collect()
    return {(r["session"], (r["ts"] - START).total_seconds()): r for r in got}


def test_trailing_window_is_open_at_its_far_end(spark):
    got = trailing(spark, [call("a", 0, 500), call("a", 30, 200), call("a", 60, 1), call("a", 89.9, 1)], limit=600)
    assert [got[("a", s)]["used"] for s in (0, 30, 60, 89.9)] == [500, 700, 201, 202]
    assert got[("a", 30)]["over_limit"] and not got[("a", 60)]["over_limit"]
    assert got[("a", 60)]["headroom"] == 399


def test_trailing_window_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [call(rng.choice(["hot", "hot", "cold"]), rng.randrange(0, 7200) / 2, rng.randrange(0, 9)) for _ in range(2000)]
    got = trailing(spark, rows, limit=100, expected=5)
    for (session, at), r in got.items():
        used = sum(
            c[4] for c in rows if c[0] == session and 0 <= at - (c[1] - START).total_seconds() < 60
        )
        assert r["used"] == used
        assert r["over_limit"] == (used + 5 > 100)
    instants = {(c[0], (c[1] - START).total_seconds()) for c in rows if c[4] > 0}
    assert set(got) == instants


def test_calls_per_minute(spark):
    df = spark.createDataFrame([call("a", 0), call("a", 59), call("a", 60), call("b", 61)], CALLS)
    got = {(r["session"], r["minute"].minute): r["n_calls"] for r in usage.calls_per_minute(df, ["session"]).collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("b", 1): 1}


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((call(rng.choice("ab"), rng.randrange(3600), 2) for _ in range(300)), key=lambda c: c[1])
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], CALLS).coalesce(1).write.mode("append").parquet(source)
    calls = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = stream.stream_calls_per_minute(calls, ["session"], "2 hours")
    stream.run_to_files(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = stream.latest_counts(spark, str(tmp_path / "out"), ["session"])
    expected = usage.calls_per_minute(spark.createDataFrame(rows, CALLS), ["session"])
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_prices(spark):
    book = spark.createDataFrame(
        [
            ("north/fast", 0, 1.0, 2.0, None, None),
            ("fast-2", 1, 3.0, 4.0, None, None),
            ("fast-1", 2, 5.0, 6.0, 7.0, 0.5),
            ("slow", 3, 8.0, 9.0, None, None),
        ],
        PRICE_BOOK,
    )
    fallback = spark.createDataFrame([("old", 0, 10.0, 11.0, None, None)], PRICE_BOOK)
    asked = ["north/fast", "fast", "fast-1", "south/slow", "south/slo", "x/old", "unknown"]
    models = spark.createDataFrame([(m,) for m in asked], "model string")
    got = {r["model"]: (r["input"], r["is_default"]) for r in usage.resolve_prices(models, book, fallback).collect()}
    assert got == {
        "north/fast": (1.0, False),
        "fast": (3.0, False),
        "fast-1": (5.0, False),
        "south/slow": (8.0, False),
        "south/slo": (8.0, False),
        "x/old": (10.0, False),
        "unknown": (3.0, True),
    }


def test_costs_and_totals(spark):
    book = spark.createDataFrame([("m", 0, 2.0, 10.0, None, None)], PRICE_BOOK)
    rows = [("a", START, "m", 1_000_000, 100_000, 40_000, 50_000), ("a", START + dt.timedelta(minutes=2), "m", 1, 0, 0, 0)]
    costed = usage.call_costs(spark.createDataFrame(rows, CALLS), book)
    costs = [r["cost"] for r in costed.orderBy("ts").collect()]
    assert costs == pytest.approx([2.0 + 1.0 + 0.04 * 2.5 + 0.05 * 0.2, 2e-6])
    total = usage.session_totals(costed, context_window=1_000_000).first()
    assert (total["n_calls"], total["avg_input"], total["avg_output"]) == (2, 500_000, 50_000)
    assert total["calls_per_minute"] == pytest.approx(1.0)
    assert total["context_pct"] == pytest.approx((500_000 + 45_000) / 1_000_000 * 100)


LOG = "run int, pos int, sql string, reason string, plain_language string, result string"


def test_query_log(spark):
    log = spark.createDataFrame(
        [
            (0, 0, "SELECT 1", "why", "", "r"),
            (0, 1, " SELECT 1\n", "", "", "r"),
            (1, 0, "select 1", "", "plain", "x" * 900),
            (1, 1, "SELECT 1", "", "", "r"),
        ],
        LOG,
    )
    kept = querylog.dedup_queries(log)
    assert {(r["run"], r["pos"]) for r in kept.collect()} == {(0, 0), (1, 0)}
    totals = {r["run"]: (r["n_queries"], r["n_unique"]) for r in querylog.log_totals(log, kept).collect()}
    assert totals == {0: (2, 1), 1: (2, 1)}
    short = {r["run"]: r for r in querylog.shorten(kept).collect()}
    assert short[0]["label"] == "why" and short[1]["label"] == "plain"
    assert short[1]["result"] == "x" * 800 + "\n... (truncated)"
    long = spark.createDataFrame([(0, 0, "SELECT " + "9" * 300, "", "", "r")], LOG)
    assert querylog.shorten(long).first()["sql"] == "SELECT " + "9" * 300


def test_proposals_keep_every_statement(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", "late"), (0, 3, "a", "early"), (2, 0, "a", " LATE ;"), (1, 1, "b", "x" * 130)],
        "run int, pos int, name string, sql string",
    )
    union = querylog.union_proposals(rows)
    assert {(r["name"], r["sql"], tuple(r["runs"])) for r in union.collect()} == {
        ("a", "early", (0,)), ("a", "late", (1, 2)), ("b", "x" * 130, (1,)),
    }
    cut = {r["name"]: r["sql"] for r in querylog.shorten_proposals(union).collect()}
    assert cut["b"] == "x" * 120 + "…"


def test_metric_builders(spark):
    rows = [("2024-01-05", "x", 1.0), ("2024-01-20", "y", 2.0), ("2024-03-01", "x", 4.0), (None, "x", 8.0)]
    df = spark.createDataFrame(rows, "d string, k string, v double").withColumn("ts", F.col("d").cast("timestamp"))

    def series(result):
        return sorted(map(tuple, result.collect()))

    assert series(metrics.count_metric(df, "ts", "monthly")) == [("2024-01", 2), ("2024-03", 1)]
    assert series(metrics.sum_metric(df, "ts", F.col("v"), "annual")) == [("2024-01", 7.0)]
    assert series(metrics.average_metric(df, "ts", F.col("v"), "quarterly")) == [("2024-01", 7.0 / 3)]
    assert series(metrics.rate_metric(df, "ts", F.col("k") == "x", "monthly")) == [("2024-01", 0.5), ("2024-03", 1.0)]
    assert series(metrics.rate_metric(df, "ts", F.col("v") > 1, "monthly", F.col("k") == "y")) == [
        ("2024-01", 1.0),
        ("2024-03", None),
    ]
    assert series(metrics.cumulative_metric(df, "ts", "monthly")) == [("2024-01", 2), ("2024-03", 3)]
    assert series(metrics.split_metric(df, "ts", "k", "New", "monthly")) == [
        ("New (x)", "2024-01", 1),
        ("New (x)", "2024-03", 1),
        ("New (y)", "2024-01", 1),
    ]
    assert metrics.tick_metric(df, "ts", F.col("v")).count() == 4
    parent = spark.createDataFrame([("x", "east"), ("y", "west")], "id string, side string")
    got = metrics.cross_table_metric(df, parent, "k", "id", "ts", "annual", F.col("v"), by=["side"])
    assert series(got) == [("east", "2024-01", 5.0), ("west", "2024-01", 2.0)]


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    from metricloom.plans.queries import QUERIES

    rows = spark.range(600).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS ts",
        "id % 5 AS user_id", "'click' AS event_type", "CAST(id AS double) AS value", "'{}' AS props",
    )
    rows.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["stream_calls_per_minute"](spark, str(tmp_path)).collect()
    want = QUERIES["calls_per_minute"](spark, str(tmp_path)).collect()
    key = lambda r: str(sorted(r.asDict().items()))
    assert len(got) > 50 and sorted(got, key=key) == sorted(want, key=key)
