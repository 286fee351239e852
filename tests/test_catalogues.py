import json

import pytest

from metricloom.operators import assemble, gate, profile, propose, refine
from metricloom.plans import queries
from metricloom.sources import catalogues, tables


def metric(name, sql="SELECT 1, 2", **extra):
    base = {
        "name": name, "description": "d", "sql": sql, "time_range": {"start": "2024-01-01", "end": "2024-12-01"},
        "granularity": "monthly", "unit": "count", "tables_used": ["orders"], "confidence": "high", "agent_notes": "n",
    }
    return {**base, **extra}


def document(connection, metrics=(), facts=None):
    doc = {
        "analysed_at": "2024-01-01T00:00:00", "model": "m", "connection": connection, "dialect": "sqlite",
        "description": "D", "overview": "", "tables": [{"name": "orders", "row_count": 3}],
        "measurable_metrics": list(metrics), "time_coverage": {"start": "", "end": ""}, "data_quality_notes": [],
    }
    if facts is not None:
        doc["queryable_facts"] = facts
    return doc


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for path, doc in {
        "alpha/shop_catalogue_2.json": document("sqlite:///data/shop.db", [metric("a", "SELECT 1, 2 ;; "), metric("b"), metric("a", "SELECT 3, 4")]),
        "beta/shop_catalogue.json": document("postgresql://h/shop?x=1", [metric("c")], [{"name": "f", "sql": "SELECT 1"}]),
        "alpha/none_catalogue_1.json": document(""),
        "alpha/notes.json": {"x": 1},
        "alpha/deep/er_catalogue_1.json": document("sqlite:///x.db"),
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(doc, indent=2))
    return root


def test_discovery_and_identity(spark, folder):
    paths = catalogues.find_catalogues(spark, [str(folder), "given.json", "readme.txt"])
    assert [p.rsplit("/", 1)[-1] for p in paths] == [
        "none_catalogue_1.json", "shop_catalogue_2.json", "shop_catalogue.json", "given.json",
    ]
    docs = catalogues.read_catalogues(spark, paths[:-1])
    index = {r["label"]: (r["run_index"], r["db_stem"]) for r in catalogues.catalogue_index(docs).collect()}
    assert index == {"alpha": (2, "shop"), "beta": (1, "shop")}


def test_entries(spark, folder):
    docs = catalogues.read_catalogues(spark, [f"{folder}/alpha/shop_catalogue_2.json", f"{folder}/beta/shop_catalogue.json"])
    rows = catalogues.metric_rows(docs)
    assert rows.count() == 4
    assert rows.where("pos = 0 AND name = 'a'").first()["sql"] == "SELECT 1, 2"
    kept = {r["name"]: r["sql"] for r in catalogues.by_name(rows).collect()}
    assert kept == {"a": "SELECT 3, 4", "b": "SELECT 1, 2", "c": "SELECT 1, 2"}
    assert [r["name"] for r in catalogues.fact_rows(docs).collect()] == ["f"]
    assert catalogues.table_rows(docs).count() == 2
    assert [r["field"] for r in gate.missing_fields(docs).collect()] == ["overview"] * 2


def test_proposal_build_write_read(spark, tmp_path):
    orders = spark.range(1, 400).selectExpr(
        "id AS order_id", "DATE '2024-01-01' + CAST(id AS int) AS placed", "CAST(id * 1.5 AS double) AS amount",
        "CASE id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'paid' ELSE NULL END AS state", "CAST(id % 5 AS int) AS shop_id",
    )
    shops = spark.createDataFrame([(i, f"Shop {i}") for i in range(5)], "shop_id int, name string")
    found = {"orders": orders, "shops": shops}
    tables.register(found)
    snapshot = profile.introspect(
        spark, found, {"orders": ["order_id"], "shops": ["shop_id"]}, [("orders", ["shop_id"], "shops", ["shop_id"])]
    )
    metrics = propose.propose_metrics(snapshot)
    names = {r["name"] for r in metrics.select("name").collect()}
    assert {"Orders", "Total Amount", "Average Amount", "Orders (new)", "Orders (paid)", "Orders Per Shops Rate"} <= names
    assert gate.ghost_violations(metrics).count() == 0
    assert gate.runnable(spark, metrics).count() == metrics.count()
    summary = spark.createDataFrame(
        [("proposal", "orders", 1, None, None), ("proposal", "elsewhere", 9, "x", ["k"])],
        "catalogue_id string, name string, row_count bigint, description string, key_columns array<string>",
    )
    head = spark.createDataFrame(
        [("proposal", None, "about", ["said"], None)],
        "catalogue_id string, description string, overview string, data_quality_notes array<string>, "
        "key_terms array<struct<term:string,definition:string>>",
    )
    built = assemble.build_catalogue(head, metrics, propose.propose_facts(snapshot), summary, snapshot, "rules")
    row = built.first()
    counts = {t["name"]: (t["row_count"], t["description"], t["data_quality_notes"]) for t in row["tables"]}
    assert counts["orders"] == (399, "", ["Column state: 33% empty (133 rows)"])
    assert counts["elsewhere"] == (9, "x", [])
    assert tuple(row["time_coverage"]) == ("2024-01-02", "2025-02-03")
    assert row["description"] == "" and row["key_terms"] == []
    assert row["data_quality_notes"][-1] == "said" and "Table shops: only" in row["data_quality_notes"][0]
    assert [tuple(r) for r in row["table_relationships"]] == [("orders", "shops", "shop_id")]
    assert [m["name"] for m in row["measurable_metrics"]] == [
        r["name"] for r in metrics.orderBy("pos").select("name").collect()
    ]
    out = str(tmp_path / "out")
    catalogues.write_catalogues(built, out, "run1")
    catalogues.write_catalogues(built, out, "run2")
    again = catalogues.read_written(spark, out)
    assert again.count() == 2
    assert catalogues.metric_rows(again).count() == 2 * metrics.count()


def test_submission_rules(spark):
    good = {
        "tables": [{"name": "t"}], "measurable_metrics": [metric("a")], "queryable_facts": [], "description": "d",
        "overview": "o",
    }
    cases = {
        "good": good,
        "bare": {**good, "tables": ["t"]},
        "text": {**good, "tables": "t"},
        "encoded": {**good, "tables": json.dumps(good["tables"])},
        "absent": {k: v for k, v in good.items() if k not in ("overview", "tables")},
        "empty": {**good, "measurable_metrics": [], "tables": []},
        "none": {**good, "tables": None},
        "loose": {**good, "measurable_metrics": ["just text"]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "submission_id string, data string")
    got = {}
    for r in gate.submission_gate(df, min_metrics=1).collect():
        got.setdefault(r["submission_id"], set()).add((r["rule"], r["detail"]))
    assert got == {
        "bare": {("bare_tables", "t")},
        "text": {("tables_not_list", "text")},
        "absent": {("keys_absent", "overview,tables")},
        "empty": {("empty_lists", "measurable_metrics,tables")},
        "none": {("tables_not_list", "null"), ("empty_lists", "tables")},
        "loose": {("too_few_metrics", "0")},
    }


def test_item_rules(spark):
    doc = {
        "measurable_metrics": [
            metric("ok"),
            {k: v for k, v in metric("gone").items() if k != "unit"},
            metric("gran", granularity="hourly"),
            metric("conf", confidence="sure"),
            metric("range", time_range={"start": "2024-01-01"}),
            metric("used", tables_used="orders"),
            "skipped",
        ],
        "queryable_facts": [{"name": "f", "description": "d", "sql": "s", "agent_notes": "n"}, {"name": "g"}],
        "key_terms": [{"term": "t"}],
        "table_relationships": [{"table_a": "a", "table_b": "b"}],
    }
    df = spark.createDataFrame([("s", json.dumps(doc))], "submission_id string, data string")
    got = {(r["field"], r["idx"], r["name"], r["rule"]) for r in gate.item_violations(df).collect()}
    m, f = "measurable_metrics", "queryable_facts"
    assert got == {
        (m, 1, "gone", "unit:missing"),
        (m, 2, "gran", "granularity:not_allowed"),
        (m, 3, "conf", "confidence:not_allowed"),
        (m, 4, "range", "time_range.end:missing"),
        (m, 5, "used", "tables_used:not_a_list"),
        (f, 1, "g", "description:missing"),
        (f, 1, "g", "sql:missing"),
        (f, 1, "g", "agent_notes:missing"),
        ("key_terms", 0, "t", "definition:missing"),
        ("table_relationships", 0, "", "join_key:missing"),
    }


def test_restored_tables_and_name_changes(spark):
    schema = "catalogue_id string, name string, row_count bigint, data_quality_notes array<string>"
    refined = spark.createDataFrame([("c", "a", 0, []), ("c", "new", 3, ["x"])], schema)
    original = spark.createDataFrame([("c", "a", 10, ["n"]), ("c", "old", 1, [])], schema)
    got = {r["name"]: (r["row_count"], r["data_quality_notes"]) for r in refine.restore_tables(refined, original).collect()}
    assert got == {"a": (10, ["n"]), "new": (3, ["x"])}
    changes = {(r["name"], r["change"]) for r in refine.name_changes(original, refined).collect()}
    assert changes == {("old", "removed"), ("new", "added")}


def test_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "other.txt").write_text("x")
    found = tables.open_folder(spark, str(tmp_path))
    assert list(found) == ["a", "b"] and found["a"].count() == 4
    assert tables.sample_rows(spark, found, 2).count() == 4
    lines = {r["line"] for r in tables.schema_lines(tables.table_columns(spark, found)).collect()}
    assert lines == {"a(id)", "b(id)"}


def test_previews(spark):
    spark.range(7).selectExpr("id", "CASE WHEN id = 1 THEN NULL ELSE 'v' END AS v").coalesce(1).createOrReplaceTempView("seven")

    def text(sql, **kw):
        return tables.preview(spark, sql, **kw).first()["result"]

    assert text("SELECT id, v FROM seven", max_rows=2) == "id | v\n----------\n0 | v\n1 | None\n(truncated to 2 rows)"
    assert text("SELECT id FROM seven WHERE id > 9") == "Query returned 0 rows."
    assert text("DELETE FROM seven") == "ERROR: Only SELECT queries are allowed."
    assert text("SELECT nope FROM seven").startswith("ERROR: ")
    assert text("SELECT 1; DROP VIEW seven").startswith("ERROR: ")
    assert text("SELECT id FROM seven", max_chars=5) == "id\n--\n... (truncated)"
    assert spark.sql("SELECT count(*) FROM seven").first()[0] == 7


def test_document_files_are_written_by_many_tasks_and_opened_once(spark, tmp_path, monkeypatch):
    suppliers = spark.range(1, 41).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "id % 3 AS s_nationkey")
    suppliers.write.parquet(str(tmp_path / "tables" / "supplier.parquet"))
    monkeypatch.setattr(queries, "_scratch", lambda _: str(tmp_path / "own"))
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    found = queries.broken_documents(spark, str(tmp_path / "tables"))
    assert spark.conf.get(listing) == before
    files = list((tmp_path / "own" / "files").glob("s_suppkey=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 4
    for file in files:
        file.unlink()
    got = {r["s_suppkey"]: (r["reason"], r["names"]) for r in found.collect()}
    assert len(got) == 40 and got[1][0] == "no JSON" and got[4] == ("", "S4")
