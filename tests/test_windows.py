import datetime as dt
import random

from pyspark.sql import functions as F

from metricloom.operators import usage
from metricloom.streaming import calls as call_stream
from metricloom.streaming import windows

START = dt.datetime(2024, 5, 1, 23, 58)
SCHEMA = "session long, ts timestamp, output_tokens long"


def made(rng, sessions, n, spread):
    return [
        (rng.choice(sessions), START + dt.timedelta(microseconds=rng.randrange(spread) * 250_000), rng.randrange(0, 50))
        for _ in range(n)
    ]


def greedy_by_hand(rows):
    found = {}
    for session in {r[0] for r in rows}:
        start = None
        for _, ts, tokens in sorted(r for r in rows if r[0] == session):
            if start is None or ts >= start + dt.timedelta(seconds=60):
                start = ts
            n, t = found.get((session, start), (0, 0))
            found[session, start] = (n + 1, t + tokens)
    return found


def test_greedy_minutes_by_hand(spark):
    rng = random.Random(1)
    for rows in (made(rng, [1], 800, 9000), made(rng, [1, 2, 3], 300, 40_000), made(rng, [1], 400, 200), [(4, START, 7)]):
        got = usage.greedy_minutes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        assert {(r["session"], r["start"].replace(tzinfo=None)): (r["n_calls"], r["tokens"]) for r in got} == greedy_by_hand(rows)
        assert len(got) == len(greedy_by_hand(rows))
    assert usage.greedy_minutes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minute_boundary_restarts(spark):
    at = [0, 59.999999, 60, 119.999999, 120, 300]
    rows = [(1, START + dt.timedelta(seconds=s), 1) for s in at]
    got = usage.greedy_minutes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["n_calls"] for r in got.collect()) == [1, 1, 2, 2]


def test_stream_equals_batch(spark, tmp_path):
    """Files in several micro-batches, calls out of order across them within the delay."""
    rng = random.Random(3)
    rows = sorted(made(rng, [1, 2], 500, 6000), key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(0, 50)))
    folder = tmp_path / "in"
    for i in range(0, len(rows), 100):
        part = spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    used = windows.stream_trailing_tokens(calls)
    call_stream.run_to_files(used, str(tmp_path / "used"), str(tmp_path / "state"))
    got = windows.final_tokens(spark, str(tmp_path / "used"), limit=300, expected=10)
    want = usage.trailing_tokens(spark.createDataFrame(rows, SCHEMA), limit=300, expected=10)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    batches = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "used"))
    assert batches.select(F.countDistinct("batch_id")).first()[0] > 1
