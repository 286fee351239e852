import json

import pytest

from metricloom.operators import workflow
from metricloom.schemas import FACT_ROW, METRIC_ROW
from metricloom.sources.tables import open_catalog, register


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame(
        [(i, f"2024-{i % 12 + 1:02d}-01", ["new", "paid"][i % 2], f"k{i % 9}", float(i)) for i in range(48)],
        "id int, day string, state string, kind string, amount double",
    )
    tables = {"orders": orders, "shops": spark.createDataFrame([(1, "a")], "id int, name string")}
    register(tables)
    return tables


def metric(pos, name, sql, start="2024-01-01", end="2024-12-01"):
    return ("c", pos, name, "", sql, (start, end), "monthly", "u", ["orders"], "high", "", "")


def test_refinement(spark, shop):
    metrics = spark.createDataFrame(
        [
            metric(0, "Fine", "SELECT day, sum(amount) FROM orders GROUP BY 1 ORDER BY 1"),
            metric(1, "Late", "SELECT day, sum(amount) FROM orders GROUP BY 1 ORDER BY 1 -- x", "2024-03-01", "2024-05-01"),
            metric(2, "By State", "SELECT day, state, sum(amount) AS v FROM orders GROUP BY 1, 2 ORDER BY 1"),
            metric(3, "By Kind", "SELECT day, kind, count(*) AS v FROM orders GROUP BY 1, 2 ORDER BY 1"),
            metric(4, "Scalar", "SELECT count(*) FROM orders"),
            metric(5, "Nothing", "SELECT day, amount FROM orders WHERE amount < 0"),
            metric(6, "Same", "SELECT day, count(*) FROM orders GROUP BY 1 ORDER BY 1"),
            metric(7, "Broken", "SELECT nope FROM orders"),
        ],
        METRIC_ROW,
    )
    facts = spark.createDataFrame([("c", 0, "Shops", "", "SELECT * FROM shops", ["shops"], "", "")], FACT_ROW)
    out = workflow.refine_catalogue(spark, metrics, facts)
    kept = {r["name"]: r for r in out.metrics.collect()}
    assert set(kept) == {"Fine", "Late", "By State (new)", "By State (paid)", "Same", "Broken"}
    assert tuple(kept["Late"]["time_range"]) == ("2024-01-01", "2024-12-01")
    assert kept["Same"]["agent_notes"] == "Same value in all 12 rows."
    assert {r["name"] for r in out.facts.collect()} == {"Shops", "By Kind", "Scalar"}
    status = {r["name"]: (r["status"], r["error"]) for r in out.metric_results.collect()}
    assert status["Late"] == status["By State (new)"] == status["By State (paid)"] == ("PASS", "")
    assert {r["status"] for r in out.fact_results.collect()} == {"PASS"}
    assert [r["note"] for r in out.notes.collect()] == ["Metric removed, no data: Nothing"]
    total = out.summary.first()
    assert (total["n_before"], total["n_after"], total["n_removed"], total["n_added"]) == (8, 6, 4, 2)
    assert total["n_patched"] == 1 and not total["lost_half"]
    pairs = workflow.pair_results(out.metrics, out.metric_results)
    assert pairs.where("status = 'FAIL'").select("name").first()["name"] == "Broken"


def test_odd_statements_do_not_end_a_refinement(spark, shop):
    """No number to measure, no category to split by, one name twice, category last."""
    statements = {
        "Texts": "SELECT day, state, kind FROM orders",
        "Numbers": "SELECT day, count(*) AS n, 2.5 AS a FROM orders GROUP BY 1",
        "Twice": "SELECT day, state AS x, sum(amount) AS x FROM orders GROUP BY 1, 2",
        "Last": "SELECT day, sum(amount) AS v, state FROM orders GROUP BY 1, 3",
        "Quoted": "SELECT day, CASE WHEN state = 'new' THEN 'b\\\\' ELSE 'it''s' END AS `s``s`, 1.0 * count(*) AS v FROM orders GROUP BY 1, 2",
    }
    metrics = spark.createDataFrame(
        [metric(i, n, sql) for i, (n, sql) in enumerate(statements.items())], METRIC_ROW
    )
    facts = spark.createDataFrame([], FACT_ROW)
    out = workflow.refine_catalogue(spark, metrics, facts)
    kept = {r["name"] for r in out.metrics.collect()}
    assert {"Twice (new)", "Twice (paid)", "Last (new)", "Last (paid)"} <= kept
    assert len([n for n in kept if n.startswith("Quoted (")]) == 2
    assert {r["name"] for r in out.facts.collect()} == {"Texts", "Numbers"}
    assert all(r["sql_ok"] for r in out.metric_results.collect())


def test_comparison(spark, shop, tmp_path):
    good = {
        "name": "Orders", "description": "", "sql": "SELECT day, sum(amount) FROM orders GROUP BY 1 ORDER BY 1",
        "time_range": {"start": "2024-01-01", "end": "2024-12-01"}, "granularity": "monthly", "unit": "u",
        "tables_used": ["orders"], "confidence": "high", "agent_notes": "",
    }
    twin = {**good, "name": "Twin"}
    broken = {**good, "name": "Broken", "sql": "SELECT nope FROM orders"}

    def save(label, name, connection, metrics, tables=()):
        doc = {
            "connection": connection, "tables": [{"name": t, "row_count": 1} for t in tables],
            "measurable_metrics": metrics, "queryable_facts": [],
        }
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_text(json.dumps(doc))

    save("alpha", "shop_catalogue_1.json", "postgresql://h/shop", [good], ["shops"])
    save("beta", "shop_catalogue_1.json", "sqlite:///data/shop.db", [good, twin, broken])
    save("beta", "other_catalogue_1.json", "sqlite:///other.db", [good])
    ranked, models, unmatched = workflow.compare_catalogues(spark, {"/data/shop.db": shop}, [str(tmp_path)])
    got = {r["label"]: r for r in ranked.collect()}
    assert (got["alpha"]["composite"], got["alpha"]["rank"]) == (100.0, 1)
    # 1 of 3 passes, 1 of 2 tables is covered, 1 of 3 repeats another.
    assert got["beta"]["composite"] == pytest.approx(100 / 3 * 0.5 * 2 / 3, abs=0.06)
    assert (got["beta"]["n_pass"], got["beta"]["n_warn"], got["beta"]["n_fail"], got["beta"]["rank"]) == (1, 1, 1, 2)
    assert [(r["label"], r["rank"]) for r in models.orderBy("rank").collect()] == [("alpha", 1), ("beta", 2)]
    assert [r["db_stem"] for r in unmatched.collect()] == ["other"]


def test_session_catalog(spark, shop):
    found = open_catalog(spark)
    assert found["orders"].count() == 48 and "shops" in found


def test_summary(spark):
    metrics = spark.createDataFrame([("c", ["a", "b"]), ("c", ["a"])], "catalogue_id string, tables_used array<string>")
    facts = spark.createDataFrame([("c", ["a", "b"])], "catalogue_id string, tables_used array<string>")
    tables = spark.createDataFrame([("c", "a")], "catalogue_id string, name string")
    results = spark.createDataFrame([("c", "PASS"), ("c", "WARN")], "catalogue_id string, status string")
    row = workflow.catalogue_summary(metrics, facts, tables, results).first()
    assert (row["n_metrics"], row["n_cross_metrics"], row["n_cross_facts"], row["n_tables"]) == (2, 1, 1, 1)
    assert (row["n_pass"], row["n_warn"], row["n_fail"]) == (1, 1, 0)
