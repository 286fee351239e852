import os

import pytest
from pyspark.sql import functions as F

from metricloom.operators import evaluate, shared_scans
from metricloom.schemas import SERIES_STATS
from metricloom.sources import tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
MONTH = "date_format(date_trunc('month', o_orderdate), 'yyyy-MM')"


@pytest.fixture(scope="module")
def opened(spark):
    found = tables.open_folder(spark, FOLDER, names=["orders", "lineitem", "customer"])
    tables.register(found)
    spark.sql("SELECT * FROM VALUES ('2024-01', 1), (NULL, 5), ('2024-02', NULL), ('x', 3) AS t(d, v)").createOrReplaceTempView("odd")
    return found


def alone(spark, sqls):
    return {q: evaluate._measure(spark, False, q) for q in sqls}


def assert_same(spark, sqls):
    entries = spark.createDataFrame([(q,) for q in sqls], "sql string")
    got = {r["sql"]: tuple(r) for r in evaluate.measure_sql(spark, entries).collect()}
    names = SERIES_STATS.fieldNames()
    for q, want in alone(spark, dict.fromkeys(sqls)).items():
        for name, a, b in zip(names, got[q], want, strict=True):
            if name == "sql_error":
                a, b = bool(a), bool(b)
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b), (q, name)


def test_shared_and_alone_agree(spark, opened):
    series = f"SELECT {MONTH} AS m, {{v}} AS value FROM orders {{w}} GROUP BY 1 ORDER BY 1 {{o}}"
    values = ["count(*)", "sum(o_totalprice)", "avg(o_totalprice) / 2 + min(o_orderkey)", "count(DISTINCT o_custkey)",
              "max(o_orderstatus)", "try_divide(count_if(o_orderkey % 2 = 0), count(*))", "CAST(count(*) AS STRING)"]
    wheres = ["", "WHERE o_orderstatus = 'F'", "WHERE o_totalprice > 200000 AND o_orderdate IS NOT NULL",
              "WHERE o_totalprice < 0", "WHERE o_orderpriority LIKE '%''%' OR o_orderkey < 9"]
    sqls = [series.format(v=v, w=w, o=o) for v in values for w in wheres for o in ("", "DESC")]
    forms = [shared_scans.normal_form(spark, q) for q in sqls]
    assert all(forms) and len(shared_scans.passes(forms)) == -(-len(sqls) // shared_scans.WIDTH)
    assert_same(spark, sqls)


def test_other_shapes_run_alone(spark, opened):
    others = [
        f"SELECT {MONTH}, count(*) FROM orders GROUP BY 1",
        f"SELECT {MONTH}, count(*) FROM orders GROUP BY 1 ORDER BY 2",
        f"SELECT {MONTH}, count(*) FROM orders GROUP BY 1 HAVING count(*) > 3 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3",
        f"SELECT {MONTH}, count(*) FROM orders GROUP BY 1 ORDER BY 1 NULLS LAST",
        f"SELECT {MONTH}, count(*), 1 FROM orders GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH} AS m, o_orderstatus FROM orders GROUP BY 1, 2 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FROM (SELECT * FROM orders WHERE o_orderkey > 5) GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FILTER (WHERE o_orderkey > 4) FROM orders GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH}, count(*) FROM orders WHERE rand() < 2 GROUP BY 1 ORDER BY 1",
        "SELECT o_orderdate, o_totalprice FROM orders ORDER BY 1",
        "SELECT nothing FROM orders",
        "",
    ]
    assert [shared_scans.normal_form(spark, q) for q in others] == [None] * len(others)
    assert_same(spark, [others[2], others[8], others[13], others[14]])


def test_nulls_in_groups_and_values(spark, opened):
    sqls = [f"SELECT d, {v} FROM odd {w} GROUP BY 1 ORDER BY 1 {o}" for v in ("sum(v)", "max(v)", "count(v)")
            for w in ("", "WHERE v > 1", "WHERE v > 9") for o in ("", "DESC")]
    plain = [q for q in sqls if shared_scans.normal_form(spark, q)]
    if not plain:  # a view over values is no table scan
        spark.table("odd").write.mode("overwrite").saveAsTable("odd_rows")
        sqls = [q.replace("odd", "odd_rows") for q in sqls]
    try:
        assert_same(spark, sqls)
    finally:
        spark.sql("DROP TABLE IF EXISTS odd_rows")


def test_one_failing_statement_spares_the_others(spark, opened):
    sqls = [
        f"SELECT {MONTH} AS m, sum(1 DIV (o_orderkey - o_orderkey)) AS v FROM orders GROUP BY 1 ORDER BY 1",
        f"SELECT {MONTH} AS m, count(*) AS v FROM orders GROUP BY 1 ORDER BY 1",
    ]
    entries = spark.createDataFrame([(q,) for q in sqls], "sql string")
    got = {r["sql"]: r["sql_ok"] for r in evaluate.measure_sql(spark, entries).collect()}
    assert got == {sqls[0]: False, sqls[1]: True}


def test_five_hundred_statements_take_few_scans(spark, opened):
    keys = [r["o_custkey"] for r in opened["orders"].select("o_custkey").distinct().orderBy("o_custkey").limit(125).collect()]
    sqls = [
        f"SELECT {MONTH} AS m, {v} AS v FROM orders WHERE o_custkey = {k} GROUP BY 1 ORDER BY 1"
        for k in range(125) for v in ("count(*)", "sum(o_totalprice)", "avg(o_totalprice)", "max(o_totalprice)")
    ]
    assert keys and len(sqls) == 500
    seen = []
    original = shared_scans.grouped
    shared_scans.grouped = lambda s, forms: seen.append(len(forms)) or original(s, forms)
    try:
        entries = spark.createDataFrame([(q,) for q in sqls], "sql string")
        rows = evaluate.measure_sql(spark, entries)
        assert rows.count() == 500 and rows.where(F.col("sql_ok")).count() == 500
    finally:
        shared_scans.grouped = original
    assert sum(seen) == 500 and len(seen) <= 8
