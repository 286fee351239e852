import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions import coerce, json_text, periods, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT * FROM orders", ["orders"]),
        ("select * from Orders o join `customers` c on 1=1", ["customers", "orders"]),
        ('SELECT * FROM "Order Details"', ["order details"]),
        ("SELECT * FROM [Order Details]", ["order details"]),
        ("SELECT * FROM public.orders", ["orders"]),
        ('SELECT * FROM "public"."orders"', ["orders"]),
        ("SELECT * FROM (SELECT * FROM a LEFT JOIN b ON 1=1) t", ["a", "b"]),
        ("SELECT * FROM a JOIN a ON 1=1", ["a"]),
        ("SELECT EXTRACT(YEAR FROM created) FROM a", ["a", "created"]),
        ("SELECT 1", []),
    ],
)
def test_tables_referenced(spark, sql, expected):
    assert one(spark, text.tables_referenced(F.lit(sql))) == expected


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("  SELECT  1\n FROM t ;; ", "select 1 from t"),
        ("select 1 from t", "select 1 from t"),
        ("a ; ;", "a ;"),
        ("", ""),
    ],
)
def test_normalise_sql(spark, sql, expected):
    assert one(spark, text.normalise_sql(F.lit(sql))) == expected


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT 1", True),
        ("-- why\n  -- more\nselect 1", True),
        ("WITH x AS (SELECT 1) SELECT * FROM x", False),
        ("DROP TABLE t", False),
        ("-- SELECT 1", False),
    ],
)
def test_is_select(spark, sql, expected):
    assert one(spark, text.is_select(F.lit(sql))) is expected


@pytest.mark.parametrize(
    "source, redacted, stem, out",
    [
        ("postgresql://u:pw@host:5432/db", "postgresql://u:***@host:5432/db", "db", "db"),
        ("postgresql://host/my.db?x=1", "postgresql://host/my.db?x=1", "my", "my.db"),
        ("sqlite:///data/solar.db", "sqlite:///data/solar.db", "solar", "solar"),
        ("postgresql://u:a@b@Host/", "postgresql://u:***@host/", "u:a@b@Host", "db"),
        ("plain/file.db", "plain/file.db", "file", "plain/file.db"),
    ],
)
def test_connection_texts(spark, source, redacted, stem, out):
    c = F.lit(source)
    assert one(spark, text.redact(c)) == redacted
    assert one(spark, text.db_stem(c)) == stem
    assert one(spark, text.output_stem(c)) == out


def test_metric_names(spark):
    assert one(spark, text.metric_name(F.lit("support_tickets"))) == "Support Tickets"
    assert one(spark, text.metric_name(F.lit("score"), "average")) == "Average Score"
    assert one(spark, text.metric_name(F.lit("churn"), "rate")) == "Churn Rate"
    assert one(spark, text.metric_name(F.lit("accounts"), "cumulative")) == "Cumulative Accounts"
    assert one(spark, text.metric_name(F.lit("accounts"), "count", F.lit("APAC"))) == "Accounts (APAC)"
    assert len(one(spark, text.metric_name(F.lit("a" * 80)))) == 80


@pytest.mark.parametrize(
    "date, granularity, expected",
    [
        ("", "monthly", ""),
        ("2024-0", "monthly", "2024-0"),
        ("2024", "annual", "2024-01-01"),
        ("2024", "daily", "2024-01-01"),
        ("2024-06-15", "monthly", "2024-06-01"),
        ("2024-06-15", "quarterly", "2024-06-01"),
        ("2024-09-30", "annual", "2024-01-01"),
        ("2024-06-15", "weekly", "2024-06-15"),
        ("2024-06-15", "daily", "2024-06-15"),
        ("2024-06-15", "tick", "2024-06-15"),
        ("2024-06", "monthly", "2024-06-01"),
    ],
)
def test_snap_to_period(spark, date, granularity, expected):
    assert one(spark, periods.snap_to_period(F.lit(date), F.lit(granularity))) == expected


@pytest.mark.parametrize(
    "start, end, months",
    [
        ("2020-01-01", "2021-03-01", 14),
        ("2020-05", "2020-05", 0),
        ("", "2021-03-01", None),
        ("2020", "2021", None),
        ("abcd-01", "2021-01", None),
    ],
)
def test_span_months(spark, start, end, months):
    assert one(spark, periods.span_months(F.lit(start), F.lit(end))) == months


def test_numbers(spark):
    texts = ["1.0", " 2 ", "N/A", "", "1e3", "nan", "12d", "-.5", "inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r["v"] for r in df.select(coerce.to_value(F.col("t"), T.StringType()).alias("v")).collect()]
    assert got == [1.0, 2.0, None, None, 1000.0, None, None, -0.5, float("inf"), None]


def test_dates(spark):
    good = ["2024-01-01", "2024-01", "2024", "2024-01-01 10:00:00", "2024-Q1", "01/02/2024", "20240101", "Jan 2024"]
    bad = ["alpha", "", "row 7", None, "Brand#1"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").coalesce(1)
    got = [r["v"] for r in df.select(coerce.reads_as_date(F.col("t"), T.StringType()).alias("v")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
    assert one(spark, coerce.reads_as_date(F.lit(7), T.IntegerType())) is True


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('[{"name": "a", "score": 4, "reason": "r"}]', [("a", 4.0)]),
        ('```json\n[{"name": "a", "score": 4}]\n```', [("a", 4.0)]),
        ('{"x": "y", "scores": [{"name": "a", "score": 2}]}', [("a", 2.0)]),
        ('[{"name": "a", "score": 5, "reason": "x"}, {"name": "b", "sc', [("a", 5.0)]),
        ("no scores here", []),
    ],
)
def test_judge_items(spark, answer, expected):
    got = one(spark, json_text.judge_items(F.lit(answer)))
    assert [(i["name"], i["score"]) for i in got] == expected


def test_encoded_fields(spark):
    docs = {
        '{"tables": [{"name": "t"}]}': "array",
        '{"tables": "[{\\"name\\": \\"t\\"}]"}': "array",
        '{"tables": "orders"}': "text",
        '{"tables": "{\\"name\\": \\"t\\"}"}': "text",
        '{"tables": 3}': "other",
        '{"other": 3}': "absent",
    }
    for doc, kind in docs.items():
        assert one(spark, json_text.field_kind(F.try_parse_json(F.lit(doc)), "tables")) == kind, doc


def test_notes_that_are_no_text_list_are_dropped(spark):
    for doc, expected in [('{"n": ["a", "b"]}', ["a", "b"]), ('{"n": "a"}', []), ('{"n": [1]}', []), ("{}", [])]:
        assert one(spark, json_text.text_list(F.lit(doc), "n")) == expected
