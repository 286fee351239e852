import datetime as dt

import pytest

from metricloom.operators import assemble, dimensions, profile


@pytest.fixture(scope="module")
def events(spark):
    data = [(1, "2024-01-01", 3.5, "alpha"), (2, "2024-02-01", 7.1, "beta"), (3, "2024-03-01", None, "alpha")]
    return spark.createDataFrame(data, "id int, occurred_at string, magnitude double, label string")


def columns_of(spark, tables, **kw):
    return {r["column_name"]: r for r in profile.profile_columns(spark, tables, **kw).collect()}


def test_statistics_per_kind(spark, events):
    cols = columns_of(spark, {"events": events}, primary_keys={"events": ["id"]})
    assert (cols["magnitude"]["min"], cols["magnitude"]["max"], cols["magnitude"]["n_null"]) == ("3.5", "7.1", 1)
    assert cols["occurred_at"]["stat_kind"] == "range"
    assert (cols["occurred_at"]["min"], cols["occurred_at"]["max"]) == ("2024-01-01", "2024-03-01")
    assert cols["label"]["n_distinct"] == 2
    assert [tuple(v) for v in cols["label"]["top_values"]] == [("alpha", 2), ("beta", 1)]
    assert cols["id"]["primary_key"] and not cols["label"]["primary_key"]
    assert all(c["n_rows"] == 3 for c in cols.values())


def test_binary_complex_and_empty(spark):
    df = spark.createDataFrame([(b"x", [1.0], None)], "raw binary, vec array<float>, note string")
    cols = columns_of(spark, {"t": df})
    assert cols["raw"]["stat_kind"] == "binary" and cols["raw"]["n_null"] is None
    assert cols["vec"]["stat_kind"] == "complex" and cols["vec"]["min"] is None
    assert cols["note"]["n_distinct"] == 0 and cols["note"]["top_values"] == []
    empty = columns_of(spark, {"t": df.where("1 = 0")})
    assert empty["note"]["n_rows"] == 0


def test_eight_values_and_tie_break(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(20)] + [("z",), ("z",)], "c string")
    col = columns_of(spark, {"t": df})["c"]
    assert col["n_distinct"] == 21
    assert [v["value"] for v in col["top_values"]] == ["z"] + [f"v{i:02d}" for i in range(7)]


def test_long_values_keep_their_whole_text(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long,), (long,), (long + "y",), ("short",)], "c string")
    col = columns_of(spark, {"t": df})["c"]
    assert col["n_distinct"] == 3
    assert tuple(col["top_values"][0]) == (long, 2)
    assert {v["value"] for v in col["top_values"]} == {long, long + "y", "short"}


def test_foreign_keys_without_columns_are_dropped(spark):
    keys = [("a", ["x"], "b", ["y"]), ("a", [], "b", [])]
    assert profile.foreign_key_rows(spark, keys).count() == 1


def snapshot(spark, tables, pk=None, fk=None):
    return profile.introspect(spark, tables, pk, fk, "postgresql://u:pw@h/db")


def test_snapshot_text(spark, events):
    shot = snapshot(spark, {"events": events}, {"events": ["id"]})
    assert shot.connection == "postgresql://u:***@h/db"
    shown = profile.render_as_text(spark, shot)
    assert "# events, 3 rows" in shown
    assert "id (int, key): 1 to 3 | 0 null" in shown
    assert "2 values | 2 x alpha; 1 x beta | 0 null" in shown
    assert "events.label: alpha, beta" in shown
    assert "for example {" in shown


def test_junction_lookup_required(spark, events):
    links = spark.createDataFrame([], "event_id int, attendee_id int")
    people = spark.createDataFrame([(1, "a")], "id int, name string")
    shot = snapshot(
        spark,
        {"events": events, "registrations": links, "attendees": people},
        fk=[("registrations", ["event_id"], "events", ["id"]), ("registrations", ["attendee_id"], "attendees", ["id"])],
    )
    got = {r["table_name"]: r for r in dimensions.table_classes(shot).collect()}
    assert got["registrations"]["is_junction"] and got["registrations"]["is_lookup"]
    assert got["events"]["is_required"] and not got["events"]["is_lookup"]
    assert got["attendees"]["is_lookup"] and not got["attendees"]["is_required"]


@pytest.mark.parametrize(
    "value, kind, temporal",
    [
        (dt.date(2024, 1, 1), "date", True),
        (dt.datetime(2024, 1, 1), "timestamp", True),
        (dt.datetime(2024, 1, 1), "timestamp_ntz", True),
        ("2024-01-01", "string", True),
        ("January", "string", False),
        (2024, "int", False),
        (1.5, "double", False),
        (True, "boolean", False),
    ],
)
def test_temporal_columns(spark, value, kind, temporal):
    df = spark.createDataFrame([(value,)], f"year {kind}")
    shot = snapshot(spark, {"t": df})
    assert dimensions.table_classes(shot).first()["is_temporal"] is temporal


def manifest(spark, tables, pk=None, fk=None):
    found = dimensions.dimension_manifest(snapshot(spark, tables, pk, fk)).collect()
    return {(r["table_name"], r["column_name"]): (r["via"], r["values"]) for r in found}


def test_dimension_limits(spark):
    def values(n):
        return spark.createDataFrame([(f"v{i}",) for i in range(n)], "c string")

    assert manifest(spark, {"t": values(1)}) == {}
    assert ("t", "c") in manifest(spark, {"t": values(2)})
    assert ("t", "c") in manifest(spark, {"t": values(20)})
    assert manifest(spark, {"t": values(21)}) == {}


def test_json_like_values_are_no_dimension(spark):
    df = spark.createDataFrame([('{"flag": true}',), ('{"flag": false}',)], "config string")
    assert manifest(spark, {"t": df}) == {}


def test_foreign_key_takes_labels_of_a_small_table(spark):
    plans = spark.createDataFrame([(1, "Free"), (2, "Growth"), (3, "Business")], "plan_id int, name string")
    accounts = spark.range(1000).selectExpr("id AS account_id", "CAST(id % 3 + 1 AS int) AS plan_id")
    pk = {"ref_plans": ["plan_id"], "accounts": ["account_id"]}
    fk = [("accounts", ["plan_id"], "ref_plans", ["plan_id"])]
    got = manifest(spark, {"ref_plans": plans, "accounts": accounts}, pk, fk)
    assert got[("accounts", "plan_id")] == ("ref_plans", ["Business", "Free", "Growth"])
    big = spark.range(300).selectExpr("CAST(id AS int) AS plan_id", "concat('n', id % 5) AS name")
    assert ("accounts", "plan_id") not in manifest(spark, {"ref_plans": big, "accounts": accounts}, pk, fk)


def test_notes_and_coverage(spark):
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS v", "DATE '2024-01-01' + CAST(id AS int) AS day"
    )
    cols = profile.profile_columns(spark, {"t": df, "small": df.limit(5)})
    notes = {(r["table_name"], r["column_name"]): r["note"] for r in assemble.null_notes(cols).collect()}
    assert notes[("t", "v")] == "Column v: 25% empty (250 rows)"
    tables = cols.groupBy("table_name").agg({"n_rows": "max"}).toDF("table_name", "n_rows")
    assert [r["table_name"] for r in assemble.size_notes(tables).collect()] == ["small"]
    assert tuple(assemble.time_coverage(cols).first()) == ("2024-01-01", "2026-09-26")
