from pyspark.sql import functions as F

from metricloom.operators import profile, sketches
from metricloom.sources import catalogues


def test_second_profile_reads_new_files_only(spark, tmp_path):
    path, store, whole = (str(tmp_path / x) for x in ("shop", "store", "whole"))
    rows = spark.range(6000).selectExpr("id", "concat('n', id % 1500) AS name", "IF(id % 10 = 0, NULL, id % 7) AS k", "array(id) AS l")
    rows.where("id < 4000").repartition(3).write.parquet(path)
    assert len(sketches.update(spark, {"shop": path}, store)) == 3
    assert sketches.update(spark, {"shop": path}, store) == []
    rows.where("id >= 4000").repartition(2).write.mode("append").parquet(path)
    assert len(sketches.update(spark, {"shop": path}, store)) == 2
    assert len(sketches.update(spark, {"shop": path}, whole)) == 5
    some, every = (
        {r["column_name"]: tuple(r) for r in sketches.estimates(spark, s, {"shop": path}).collect()} for s in (store, whole)
    )
    assert some == every and set(some) == {"id", "name", "k"}
    exact = {"id": (6000, 0, 6000), "name": (6000, 0, 1500), "k": (6000, 600, 7)}
    for name, (n_rows, n_null, n_distinct) in exact.items():
        assert some[name][2:4] == (n_rows, n_null)
        assert abs(some[name][4] - n_distinct) <= 3 * sketches.ERROR * n_distinct + 1


def test_rewritten_and_repeated_states(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    spark.range(100).coalesce(1).write.parquet(path)
    sketches.update(spark, {"t": path}, store)
    spark.read.parquet(store).write.mode("append").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(store)  # a run that failed late
    assert sketches.estimates(spark, store, {"t": path}).first()["n_rows"] == 100
    spark.range(40).coalesce(1).write.mode("overwrite").parquet(path)
    assert len(sketches.update(spark, {"t": path}, store)) == 1
    found = sketches.estimates(spark, store, {"t": path}).first()
    assert (found["n_rows"], found["n_distinct"]) == (40, 40)


def test_ties_beyond_the_first_characters(spark):
    """Values that share their beginning and their count: the smallest whole values win, and no
    task ranks more of them than it has to."""
    start = "a" * 70
    rows = spark.range(20000).select(F.concat(F.lit(start), F.lpad(F.col("id").cast("string"), 6, "0")).alias("v"))
    rows = rows.union(spark.createDataFrame([("b",)] * 3 + [(start + "000000",)] * 2, "v string")).repartition(6)
    got = profile.profile_columns(spark, {"t": rows}, top_k=4).first()["top_values"]
    want = [(start + "000000", 3), ("b", 3)] + [(f"{start}00000{i}", 1) for i in (1, 2)]
    assert [(x["value"], x["cnt"]) for x in got] == sorted(want, key=lambda x: (-x[1], x[0]))
    plan = profile._frequencies({"t": rows}, profile._plan({"t": rows}), 4)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "rank(" not in plan.replace("dense_rank", "")


def test_few_values_and_no_ranking(spark):
    rows = spark.createDataFrame([("x", None), ("y", None), ("x", None)], "v string, w string")
    got = {r["column_name"]: r for r in profile.profile_columns(spark, {"t": rows}, top_k=5).collect()}
    assert [(x["value"], x["cnt"]) for x in got["v"]["top_values"]] == [("x", 2), ("y", 1)]
    assert got["w"]["top_values"] == [] and got["w"]["n_distinct"] == 0
    none = {r["column_name"]: r for r in profile.profile_columns(spark, {"t": rows}, top_k=0).collect()}
    assert none["v"]["n_distinct"] == 2 and none["v"]["top_values"] == []


def test_reports_of_other_databases_stay(spark, tmp_path):
    folder = str(tmp_path / "reports")
    schema = "db_stem string, catalogue_id string, composite double"
    for db, score in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        catalogues.write_scores(spark.createDataFrame([(db, "c", score)], schema), folder)
    rows = catalogues.read_scores(spark, folder, spark.createDataFrame([], schema).schema)
    assert sorted((r["db_stem"], r["composite"]) for r in rows.collect()) == [("a", 3.0), ("b", 2.0)]
