import pytest
from pyspark.sql import functions as F

from metricloom.operators import keys, lineage


def test_keys_and_references(spark):
    n = 3000
    shops = spark.range(50).selectExpr("id AS s_shopkey", "concat('s', id % 49) AS s_name")
    bills = spark.range(n).selectExpr(
        "id AS b_billkey", "id % 50 AS b_shopkey", "id % 60 AS b_otherkey", "IF(id = 7, NULL, id) AS b_code",
        "concat('x', IF(id = 9, 8, id)) AS b_text",
    )
    lines = bills.selectExpr("b_billkey AS l_billkey", "explode(sequence(1, 3)) AS l_no", "b_shopkey + 1 AS l_shopkey")
    empty = spark.createDataFrame([], "e_billkey long, e_name string")
    tables = {"shops": shops, "bills": bills, "lines": lines, "empty": empty}
    found = keys.infer_keys(spark, tables)
    assert sorted((r["table_name"], tuple(r["columns"])) for r in found.collect()) == [
        ("bills", ("b_billkey",)), ("lines", ("l_billkey", "l_no")), ("shops", ("s_shopkey",)),
    ]
    links = keys.infer_references(spark, tables, found)
    assert sorted(map(tuple, links.collect())) == [
        ("bills", "b_shopkey", "shops", "s_shopkey"), ("lines", "l_billkey", "bills", "b_billkey"),
    ]
    none = {"empty": empty}
    assert keys.infer_keys(spark, none).count() == 0
    assert keys.infer_references(spark, none, keys.infer_keys(spark, none)).count() == 0


@pytest.mark.parametrize("n", [10, 5000, 40000])
def test_a_subset_never_changes_the_sketch(spark, n):
    """Whatever the sizes, a true reference is a candidate."""
    parent = spark.range(n).selectExpr("id AS p_key")
    tables = {"p": parent}
    for i, step in enumerate((1, 2, 7, n)):
        tables[f"c{i}"] = spark.range(0, n, step).selectExpr("id AS c_key").union(spark.createDataFrame([(None,)], "c_key long"))
    found = keys.infer_keys(spark, {"p": parent})
    links = keys.infer_references(spark, tables, found)
    assert {r["from_table"] for r in links.collect()} == {"c0", "c1", "c2", "c3"}


def test_one_stray_value_is_no_reference(spark):
    tables = {"p": spark.range(20000).selectExpr("id AS p_key"), "c": spark.range(19999).selectExpr("id AS c_key").union(spark.range(1).selectExpr("20001L"))}
    assert keys.infer_references(spark, tables, keys.infer_keys(spark, {"p": tables["p"]})).count() == 0


@pytest.mark.parametrize(
    "sql, tables, sources",
    [
        ("SELECT a FROM t1", ["t1"], {"a": ["t1.a"]}),
        ("SELECT x.a + y.b AS s, 1 AS one FROM t1 x JOIN t2 AS y ON x.a = y.b", ["t1", "t2"], {"s": ["t1.a", "t2.b"], "one": []}),
        ("SELECT * FROM t1, t2", ["t1", "t2"], {"a": ["t1.a"], "b": ["t2.b"]}),
        ("WITH t2 AS (SELECT a AS b FROM t1) SELECT max(b) AS m FROM t2", ["t1"], {"m": ["t1.a"]}),
        ("WITH c AS (SELECT a FROM t1), d AS (SELECT a + 1 AS e FROM c) SELECT c.a, d.e FROM c JOIN d ON c.a = d.e", ["t1"], {"a": ["t1.a"], "e": ["t1.a"]}),
        ("SELECT a FROM t1 WHERE EXISTS (SELECT 1 FROM t2 WHERE b = a)", ["t1", "t2"], {"a": ["t1.a"]}),
        ("SELECT (SELECT max(b) FROM t2) AS m FROM t1", ["t1", "t2"], {"m": ["t2.b"]}),
        ("SELECT a AS v FROM t1 UNION SELECT b FROM t2", ["t1", "t2"], {"v": ["t1.a", "t2.b"]}),
        ("SELECT explode(sequence(1, a)) AS e FROM t1", ["t1"], {"e": ["t1.a"]}),
        ("SELECT sum(a) OVER (ORDER BY a) AS r FROM (SELECT * FROM t1) AS q", ["t1"], {"r": ["t1.a"]}),
        ("SELECT 'FROM t2' AS c FROM v1", ["v1"], {"c": []}),
        ("SELECT 1 AS c", [], {"c": []}),
    ],
)
def test_resolved_tables(spark, tmp_path, sql, tables, sources):
    for name, column in (("t1", "a"), ("t2", "b")):
        spark.range(5).selectExpr(f"CAST(id AS int) AS {column}").write.mode("overwrite").parquet(str(tmp_path / name))
        spark.read.parquet(str(tmp_path / name)).createOrReplaceTempView(name)
    spark.sql("SELECT a FROM t1").createOrReplaceTempView("v1")
    _, ok, found, columns = lineage.resolve(spark, sql)
    assert ok and found == tables and dict(columns) == sources


def test_unresolved_statement_and_ghosts(spark):
    spark.range(3).createOrReplaceTempView("plain_ids")
    entries = spark.createDataFrame(
        [("m", "SELECT id FROM plain_ids", ["plain_ids", "Other"]), ("n", "SELECT nope FROM plain_ids", ["plain_ids"])],
        "name string, sql string, tables_used array<string>",
    )
    resolved = lineage.resolved_tables(spark, entries)
    assert {r["sql"]: r["ok"] for r in resolved.collect()} == {e: e.startswith("SELECT id") for e in ("SELECT id FROM plain_ids", "SELECT nope FROM plain_ids")}
    ghosts = lineage.resolved_ghosts(entries, resolved).select("name", F.array_join("ghosts", ",")).collect()
    assert [tuple(r) for r in ghosts] == [("m", "other")]
