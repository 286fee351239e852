"""Checks a submitted catalogue must pass, over a table of JSON documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.json_text import decode_field, field_kind
from metricloom.operators.coverage import ghost_tables
from metricloom.operators.evaluate import CONCURRENT, LOST, each_statement, run_twice
from metricloom.schemas import TEXTS
from metricloom.sources.tables import run_sql

# Keys a submission needs, lists that must not be empty, allowed values.
REQUIRED_KEYS = ("tables", "measurable_metrics", "queryable_facts", "description", "overview")
REQUIRED_LISTS = ("tables", "measurable_metrics")
GRANULARITIES = ("daily", "weekly", "monthly", "quarterly", "annual", "tick")
CONFIDENCES = ("high", "medium", "low")

METRIC_TEXTS = ("name", "description", "sql", "unit", "agent_notes")
FACT_TEXTS = ("name", "description", "sql", "agent_notes")
ITEM_RULES = {
    "measurable_metrics": METRIC_TEXTS,
    "queryable_facts": FACT_TEXTS,
    "key_terms": ("term", "definition"),
    "table_relationships": ("table_a", "table_b", "join_key"),
}


def items(submissions: DataFrame, field: str) -> DataFrame:
    """Objects of a list field as (submission_id, idx, item JSON); other items are skipped."""
    listed = F.from_json(decode_field(F.col("data"), field), TEXTS)
    rows = submissions.select("submission_id", F.posexplode(listed).alias("idx", "item"))
    return rows.where(F.ltrim("item").startswith("{"))


def item_violations(submissions: DataFrame) -> DataFrame:
    """Rule violations per item: (submission_id, field, idx, name, rule). One scan: the four
    lists are laid end to end and each item is parsed once."""
    return broken_rules(listed_items(submissions))


def listed_items(submissions: DataFrame) -> DataFrame:
    """(submission_id, field, idx, item JSON) of the objects in the four lists that have rules."""

    def listed(field: str) -> Column:
        found = F.from_json(decode_field(F.col("data"), field), TEXTS)
        tagged = F.transform(
            found, lambda x, i: F.struct(F.lit(field).alias("field"), i.cast("bigint").alias("idx"), x.alias("item"))
        )
        return F.coalesce(tagged, F.array().cast("array<struct<field:string,idx:bigint,item:string>>"))

    rows = submissions.select("submission_id", F.inline(F.concat(*map(listed, ITEM_RULES))))
    return rows.where(F.ltrim("item").startswith("{"))


def broken_rules(items: DataFrame) -> DataFrame:
    """Rule violations of ``listed_items``: (submission_id, field, idx, name, rule)."""
    rows = items.withColumn("v", F.try_parse_json("item"))

    def kind(path: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant"))
        return F.coalesce(found, F.lit("absent"))

    def texts(*paths: str) -> list[Column]:
        return [F.when(kind(t) != "STRING", F.concat(F.lit(f"{t}:"), _problem(kind(t)))) for t in paths]

    def one_of(name: str, allowed: tuple) -> Column:
        known = (kind(name) == "STRING") & F.get_json_object("item", f"$.{name}").isin(*allowed)
        return F.when(~F.coalesce(known, F.lit(False)), f"{name}:not_allowed")

    used = kind("tables_used")
    no_list = F.when(~_is_text_list(used), "tables_used:not_a_list")
    more = {
        "measurable_metrics": [
            *texts("time_range.start", "time_range.end"),
            one_of("granularity", GRANULARITIES),
            one_of("confidence", CONFIDENCES),
            no_list,
        ],
        "queryable_facts": [F.when(used != "absent", no_list)],
    }
    labels = {"key_terms": "term", "table_relationships": None}
    name, rules = F.lit(None).cast("string"), F.array().cast("array<string>")
    for field, paths in ITEM_RULES.items():
        own = F.col("field") == field
        label = labels.get(field, "name")
        shown = F.coalesce(F.get_json_object("item", f"$.{label}"), F.lit("?")) if label else F.lit("")
        name = F.when(own, shown).otherwise(name)
        rules = F.when(own, F.array(*texts(*paths), *more.get(field, []))).otherwise(rules)
    return rows.select(
        "submission_id", "field", "idx", name.alias("name"), F.explode(F.array_compact(rules)).alias("rule")
    )


def _problem(kind: Column) -> Column:
    return F.when(kind == "absent", "missing").otherwise("not_text")


def _is_text_list(kind: Column) -> Column:
    return kind.isin("ARRAY<STRING>", "ARRAY<VOID>")


def submission_gate(submissions: DataFrame, min_metrics: int = 0) -> DataFrame:
    """Reasons to send a submission back: (submission_id, rule, detail).

    A document is parsed once; each step below reads the columns of the one before.
    """
    texts = {k: decode_field(F.col("data"), k) for k in REQUIRED_LISTS}
    parsed = submissions.select(
        "submission_id", F.try_parse_json("data").alias("doc"), *[c.alias(f"t_{k}") for k, c in texts.items()]
    )
    kinds = [field_kind(F.col("doc"), k).alias(f"k_{k}") for k in REQUIRED_KEYS]
    lists = [F.from_json(f"t_{k}", TEXTS).alias(f"l_{k}") for k in REQUIRED_LISTS]
    seen = parsed.select("submission_id", *[f"t_{k}" for k in REQUIRED_LISTS], *kinds, *lists)

    def kind(field: str) -> Column:
        return F.col(f"k_{field}")

    def is_object(item: Column) -> Column:
        return F.coalesce(F.ltrim(item).startswith("{"), F.lit(False))

    absent = F.array_sort(
        F.array_compact(F.array(*[F.when(kind(k) == "absent", k) for k in REQUIRED_KEYS]))
    )
    blank = F.array_compact(
        F.array(
            *[
                F.when(
                    (kind(k) == "null")
                    | ((kind(k) == "array") & (F.size(f"l_{k}") == 0))
                    | ((kind(k) == "text") & (F.col(f"t_{k}") == "")),
                    k,
                )
                for k in sorted(REQUIRED_LISTS)
            ]
        )
    )
    first = F.get("l_tables", F.lit(0))
    listed = F.filter("l_measurable_metrics", is_object)
    rows = seen.select(
        "submission_id",
        F.when(~kind("tables").isin("absent", "array"), kind("tables")).alias("tables_not_list"),
        F.when(
            (kind("tables") == "array") & first.isNotNull() & ~is_object(first) & ~first.startswith("["), first
        ).alias("bare_tables"),
        F.nullif(F.array_join(absent, ","), F.lit("")).alias("keys_absent"),
        F.nullif(F.array_join(blank, ","), F.lit("")).alias("empty_lists"),
        F.coalesce(F.size(listed), F.lit(0)).alias("n_metrics"),
    )
    rules = ["tables_not_list", "bare_tables", "keys_absent", "empty_lists"]
    if min_metrics:
        few = F.coalesce(*rules).isNull() & (F.col("n_metrics") < min_metrics)
        rows = rows.withColumn("too_few_metrics", F.when(few, F.col("n_metrics").cast("string")))
        rules.append("too_few_metrics")
    reasons = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("detail")) for r in rules])
    return rows.select("submission_id", F.inline(reasons)).where("detail IS NOT NULL")


def missing_fields(catalogues: DataFrame) -> DataFrame:
    """Catalogues whose description or overview is absent or empty."""
    rules = [F.when(F.coalesce(f, F.lit("")) == "", f) for f in ("description", "overview")]
    return catalogues.select("catalogue_id", F.explode(F.array_compact(F.array(*rules))).alias("field"))


def ghost_violations(entries: DataFrame) -> DataFrame:
    """Entries that declare tables their statement never reads, as one line each."""
    return ghost_tables(entries).select(
        "catalogue_id", "name", F.array_join("ghosts", ",").alias("ghosts")
    )


def runnable(spark: SparkSession, entries: DataFrame, width: int = CONCURRENT) -> DataFrame:
    """Entries whose statement runs. Analysis settles most without a job; what passes
    is tried on one row."""
    tried = each_statement(spark, entries, partial(_runs, spark), "sql string, ok boolean", width)
    return entries.join(tried.where("ok").select("sql"), "sql", "left_semi")


def _runs(spark: SparkSession, sql: str) -> tuple[str, bool]:
    try:
        run_twice(partial(run_sql(spark, sql).take, 1))
    except Exception as error:  # noqa: BLE001 - a task failure arrives as a JVM error
        if any(sign in str(error) for sign in LOST):
            raise
        return sql, False
    return sql, True
