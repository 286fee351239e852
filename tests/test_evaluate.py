import pytest

from metricloom.operators import coverage, evaluate, gate, refine
from metricloom.schemas import FACT_ROW, METRIC_ROW


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    def view(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).createOrReplaceTempView(name)

    view(
        "readings",
        [("2023-01-01", 10.0), ("2023-02-01", 20.0), ("2023-03-01", 30.0), ("2023-04-01", 40.0)],
        "recorded_at string, value double",
    )
    view("flat", [(f"2024-0{i}-01", 5.0) for i in (1, 2, 3)], "dt string, val double")
    view(
        "mostly_null",
        [("2024-01-01", None), ("2024-02-01", None), ("2024-03-01", None), ("2024-04-01", 1.0)],
        "dt string, val double",
    )
    view("mixed", [("2024-01-01", "1.0"), ("2024-02-01", "N/A"), ("2024-03-01", "3.0")], "dt string, val string")
    view(
        "edges",
        [("2024-01-01", "N/A"), ("2024-02-01", "2.0"), ("2024-03-01", "3.0"), ("2024-04-01", "N/A")],
        "dt string, val string",
    )
    view("null_dates", [(None, 1.0), (None, 2.0), (None, 3.0)], "dt string, val double")
    view("bad_dates", [(f"2024-01-{i:02d}", float(i)) for i in range(1, 9)] + [("a", 9.0), ("b", 10.0)],
         "dt string, val double")
    view("one_bad", [("2024-01-01", float(i)) for i in range(99)] + [("bad", 100.0)], "dt string, val double")


def metric(name, sql, start="", end="", granularity="tick", used=("readings",), pos=0):
    return ("c", pos, name, "", sql, (start, end), granularity, "u", list(used), "high", "", "")


def results(spark, *entries):
    df = spark.createDataFrame([(*e[:1], i, *e[2:]) for i, e in enumerate(entries)], METRIC_ROW)
    evaluated = evaluate.evaluate_metrics(spark, df)
    marked = evaluate.mark_duplicates(evaluated, evaluate.duplicate_sql(df))
    return {r["name"]: r for r in marked.collect()}


ALL = "SELECT dt, val FROM {} ORDER BY dt"


def test_every_code(spark):
    got = results(
        spark,
        metric("pass", "SELECT recorded_at, value FROM readings ORDER BY 1;", "2023-01-01", "2023-04-01", "monthly"),
        metric("blank", "  "),
        metric("broken", "SELECT nope FROM readings"),
        metric("ddl", "DROP VIEW readings"),
        metric("divided", "SELECT recorded_at, 1 DIV CAST(value - value AS int) FROM readings"),
        metric("single", "SELECT count(*) FROM readings"),
        metric("none", "SELECT recorded_at, value FROM readings WHERE value > 99"),
        metric("sparse", "SELECT recorded_at, value FROM readings WHERE value > 20"),
        metric("wide", "SELECT recorded_at, value, value FROM readings -- trailing"),
        metric("flat", ALL.format("flat")),
        metric("nulls", ALL.format("mostly_null")),
        metric("mixed", ALL.format("mixed")),
        metric("edges", ALL.format("edges")),
        metric("null_dates", ALL.format("null_dates")),
        metric("bad_dates", ALL.format("bad_dates")),
        metric("one_bad", ALL.format("one_bad")),
        metric("late", ALL.format("flat"), "2024-02-01", "2024-03-01", "monthly"),
        metric("unaligned", "SELECT recorded_at, value FROM readings", "2023-01-15", "2023-04-30", "monthly"),
        metric("backwards", "SELECT recorded_at, value FROM readings ORDER BY 1 DESC"),
    )
    assert got["pass"]["status"] == "PASS" and got["pass"]["error"] == ""
    assert (got["pass"]["value_min"], got["pass"]["value_max"], got["pass"]["n_rows"]) == (10.0, 40.0, 4)
    assert (got["pass"]["actual_start"], got["pass"]["actual_end"]) == ("2023-01-01", "2023-04-01")
    assert got["blank"]["status"] == "FAIL" and got["blank"]["error"] == "No SQL in catalogue entry"
    for name in ("broken", "ddl", "divided"):
        assert got[name]["status"] == "FAIL" and not got[name]["sql_ok"], name
    assert got["single"]["error"] == "Only 1 column(s) returned; expected 2" and got["single"]["sql_ok"]
    assert (got["none"]["status"], got["none"]["error"]) == ("WARN", "zero_rows")
    assert got["sparse"]["error"] == "sparse"
    assert got["wide"]["error"] == "extra_cols" and got["wide"]["n_cols"] == 3
    assert got["flat"]["error"] == "constant_values"
    assert got["nulls"]["error"] == "high_nulls, sparse" and got["nulls"]["null_rate"] == 0.75
    assert got["mixed"]["n_rows"] == 2 and "high_nulls" in got["mixed"]["error"]
    assert (got["edges"]["actual_start"], got["edges"]["actual_end"]) == ("2024-02-01", "2024-03-01")
    assert got["null_dates"]["actual_start"] == "" and "non_date_col" in got["null_dates"]["error"]
    assert not got["bad_dates"]["date_col_ok"] and got["one_bad"]["date_col_ok"]
    assert "date_mismatch" in got["late"]["error"] and got["late"]["duplicate_of"] == "flat"
    assert got["unaligned"]["error"] == "period_boundary"
    assert (got["backwards"]["actual_start"], got["backwards"]["actual_end"]) == ("2023-04-01", "2023-01-01")


def test_duplicates(spark):
    sql = "SELECT recorded_at, value FROM readings"
    got = results(
        spark,
        metric("a", sql, granularity="daily"),
        metric("b", sql.lower() + " ;"),
        metric("c", "  " + sql.replace(" ", "  ")),
        metric("d", "SELECT nope"),
        metric("e", "select nope"),
        metric("blank1", ""),
        metric("blank2", ""),
    )
    assert [got[n]["duplicate_of"] for n in ("a", "b", "c", "d", "e", "blank2")] == ["", "a", "a", "", "d", ""]
    assert got["b"]["status"] == "WARN" and got["b"]["error"] == "duplicate_sql"
    assert got["e"]["status"] == "FAIL" and got["e"]["error"].endswith(", duplicate_sql")


def test_duplicates_of_a_hot_statement(spark):
    """One statement holds most rows and is joined by broadcast, the rest by shuffle."""
    rows = spark.range(30_000).selectExpr(
        "'c' AS catalogue_id", "id AS pos", "concat('m', id) AS name",
        "CASE WHEN id % 3 > 0 THEN 'SELECT 1' ELSE concat('SELECT ', id % 9000) END AS sql",
    )
    got = {r["pos"]: r["duplicate_of"] for r in evaluate.duplicate_sql(rows).collect()}
    first = {}
    expected = {}
    for i in range(30_000):
        sql = "SELECT 1" if i % 3 > 0 else f"SELECT {i % 9000}"
        if sql in first:
            expected[i] = first[sql]
        else:
            first[sql] = f"m{i}"
    assert got == expected


def test_facts(spark):
    rows = [
        ("c", i, n, "", sql, [], "", "")
        for i, (n, sql) in enumerate(
            [("ok", "SELECT * FROM readings"), ("empty", "SELECT * FROM readings WHERE 1=0"), ("blank", ""),
             ("bad", "SELECT * FROM missing")]
        )
    ]
    got = {r["name"]: r for r in evaluate.evaluate_facts(spark, spark.createDataFrame(rows, FACT_ROW)).collect()}
    assert (got["ok"]["status"], got["ok"]["n_rows"], got["ok"]["n_cols"]) == ("PASS", 4, 2)
    assert (got["empty"]["status"], got["empty"]["error"]) == ("WARN", "zero_rows")
    assert got["blank"]["status"] == got["bad"]["status"] == "FAIL"


def result_rows(spark, rows):
    schema = (
        "catalogue_id string, pos bigint, name string, sql_ok boolean, error string, status string, n_rows bigint, "
        "value_min double, value_max double, granularity string, declared_start string, declared_end string, "
        "actual_start string, actual_end string"
    )
    return spark.createDataFrame(rows, schema)


def row(name, error, status="WARN", ok=True, n=5, lo=1.0, hi=2.0, gran="monthly", ds="2024-01-01", de="2024-05-01",
        as_="2024-02-15", ae="2024-06-15"):
    return ("c", 0, name, ok, error, status, n, lo, hi, gran, ds, de, as_, ae)


def test_routing(spark):
    metrics = result_rows(
        spark,
        [
            row("dates", "date_mismatch"),
            row("both", "date_mismatch, period_boundary"),
            row("mixed", "date_mismatch, sparse"),
            row("crash", "eval error: boom", "FAIL"),
            row("sql", "eval error: text of a statement", "FAIL", ok=False),
            row("fine", "", "PASS"),
        ],
    )
    facts = metrics.where("name IN ('crash', 'sql')").withColumnRenamed("x", "y")
    issues = refine.needs_investigation(metrics, facts).collect()
    assert {(i["kind"], i["name"]) for i in issues} == {("METRIC", "mixed"), ("METRIC", "sql"), ("FACT", "sql")}


def test_patches(spark):
    got = {
        r["name"]: (r["new_start"], r["new_end"])
        for r in refine.patched_ranges(
            result_rows(
                spark,
                [
                    row("measured", "date_mismatch"),
                    row("snapped", "period_boundary", ds="2024-01-15", de="2024-05-31"),
                    row("both", "date_mismatch, period_boundary"),
                    row("unknown", "date_mismatch", as_="", ae=""),
                    row("fine", "sparse"),
                ],
            )
        ).collect()
    }
    assert got == {
        "measured": ("2024-02-15", "2024-06-15"),
        "snapped": ("2024-01-01", "2024-05-01"),
        "both": ("2024-02-01", "2024-06-01"),
    }


def test_actions(spark):
    rows = [
        row("one", "Only 1 column(s) returned; expected 2", "FAIL"),
        row("empty", "zero_rows", n=0),
        row("few", "extra_cols"),
        row("many", "extra_cols, sparse"),
        row("nulls", "high_nulls"),
        row("flat", "constant_values", lo=3.0, hi=3.0),
        row("fine", "", "PASS"),
    ]
    counts = spark.createDataFrame([("c", "few", 5), ("c", "many", 6)], "catalogue_id string, name string, n_categories int")
    got = {r["name"]: r["action"] for r in refine.refine_actions(result_rows(spark, rows), counts).collect()}
    assert got == {
        "one": "move_to_facts", "empty": "remove", "few": "split", "many": "move_to_facts",
        "nulls": "report", "flat": "annotate", "fine": "keep",
    }


def test_split_by_category(spark):
    spark.createDataFrame(
        [("2024-01", "it's", 1), ("2024-01", "b", 2), ("2024-02", "b", 3)], "period string, region string, n int"
    ).createOrReplaceTempView("sales")
    base = {"name": "Sales", "sql": "SELECT period, region, sum(n) AS total FROM sales GROUP BY 1, 2 ORDER BY 1;"}
    parts = refine.split_by_category(spark, base)
    assert [p["name"] for p in parts] == ["Sales (b)", "Sales (it's)"]
    assert [tuple(r) for r in spark.sql(parts[0]["sql"]).collect()] == [("2024-01", 2), ("2024-02", 3)]
    assert spark.sql(parts[1]["sql"]).count() == 1
    assert refine.category_count(spark, base["sql"]).first()["n_categories"] == 2


def test_runnable(spark):
    df = spark.createDataFrame(
        [metric("good", "SELECT * FROM readings;"), metric("bad", "SELECT zzz FROM readings"), metric("ddl", "DROP VIEW x")],
        METRIC_ROW,
    )
    assert [r["name"] for r in gate.runnable(spark, df).select("name").collect()] == ["good"]


def test_foreign_key_coverage(spark):
    keys = spark.createDataFrame(
        [("Orders", ["c"], "Customers", ["id"]), ("orders", ["s"], "ref_status", ["id"]), ("items", ["p"], "products", ["id"]),
         ("staff", ["boss"], "staff", ["id"])],
        "from_table string, from_cols array<string>, to_table string, to_cols array<string>",
    )
    exempt = spark.createDataFrame([("REF_STATUS",)], "table_name string")
    pairs = coverage.foreign_key_pairs(keys, exempt)
    entries = spark.createDataFrame(
        [metric("x", "SELECT 1 FROM customers JOIN ORDERS ON 1=1"), metric("y", "SELECT 1 FROM staff"),
         metric("z", "SELECT 1 FROM items")],
        METRIC_ROW,
    )
    got = coverage.uncovered_pairs(entries, entries, pairs).collect()
    assert [(r["from_table"], r["to_table"]) for r in got] == [("items", "products")]


def test_waivers(spark):
    log = spark.createDataFrame([("a", "B"), ("b", "A"), ("a", "c")], "table_a string, table_b string")
    got = {tuple(r["pair"]): r["waived"] for r in coverage.waived_pairs(log).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False}


def test_table_coverage_keeps_case(spark):
    entries = spark.createDataFrame([metric("x", "", used=["Orders"])], METRIC_ROW)
    db = spark.createDataFrame([("orders",), ("Orders",)], "table_name string")
    facts = spark.createDataFrame([], FACT_ROW)
    mentions = coverage.table_mentions(entries, facts)
    got = [r["table_name"] for r in coverage.uncovered_tables(entries, db, mentions).collect()]
    assert got == ["orders"]
    assert coverage.required_uncovered(entries, db, entries).count() == 0


def test_a_lost_cluster_is_no_failed_statement(spark, monkeypatch):
    from metricloom.operators import evaluate as e

    calls = []

    def lost():
        calls.append(1)
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")

    with pytest.raises(RuntimeError):
        e.run_twice(lost)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        e.run_twice(lambda: int("x"))
    with pytest.raises(RuntimeError):
        e._own_error(RuntimeError("No space left on device"))
    monkeypatch.setattr(e, "BATCH", 2)
    entries = spark.createDataFrame([(f"SELECT {i} AS a, {i} AS b",) for i in range(5)] + [("nope",)], "sql string")
    rows = e.measure_sql(spark, entries).collect()
    assert len(rows) == 6 and sum(r["sql_ok"] for r in rows) == 5
