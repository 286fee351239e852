"""Whole runs: refine one catalogue, compare many."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.text import db_stem
from metricloom.operators import coverage, evaluate, refine, scoring
from metricloom.schemas import METRIC_ROW
from metricloom.session import pin
from metricloom.sources import catalogues
from metricloom.sources.tables import register, union_all


@dataclass
class Refined:
    """Outcome of a refinement."""

    metrics: DataFrame
    facts: DataFrame
    metric_results: DataFrame
    fact_results: DataFrame
    actions: DataFrame
    notes: DataFrame
    summary: DataFrame


def _category_parts(spark: SparkSession, metric: dict) -> tuple[tuple, list[dict]]:
    n = refine.category_count(spark, metric["sql"]).first()["n_categories"]
    parts = refine.split_by_category(spark, metric) if 1 <= n <= refine.MAX_SPLIT else []
    return (metric["catalogue_id"], metric["name"], n), parts


def _categories(spark: SparkSession, metrics: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category counts of statements with more than two columns, and the metrics that
    the small ones split into. Each such statement is a job or two of its own; the driver
    holds one batch of them, which is written out before the next begins."""
    wide = results.where(F.array_contains(F.split("error", ", "), "extra_cols"))
    entries = metrics.join(wide.select("catalogue_id", "name"), ["catalogue_id", "name"])
    rows = (r.asDict(recursive=True) for r in entries.toLocalIterator())
    fields = [f.name for f in METRIC_ROW.fields]
    counts = spark.createDataFrame([], "catalogue_id string, name string, n_categories bigint")
    splits = spark.createDataFrame([], METRIC_ROW)
    with ThreadPoolExecutor(evaluate.CONCURRENT) as pool:
        while batch := list(islice(rows, evaluate.BATCH)):
            found = list(pool.map(partial(_category_parts, spark), batch))
            more = spark.createDataFrame([count for count, _ in found], counts.schema)
            parts = [tuple(p[f] for f in fields) for _, ps in found for p in ps]
            split = spark.createDataFrame(parts, METRIC_ROW)
            if len(batch) == evaluate.BATCH:
                more, split = pin(more), pin(split)
            counts, splits = counts.unionByName(more), splits.unionByName(split)
    return counts, splits


def refine_catalogue(spark: SparkSession, metrics: DataFrame, facts: DataFrame) -> Refined:
    """Evaluate, patch declared ranges, apply the action of each remaining issue, and
    evaluate again. A catalogue that would lose every entry keeps its patched ones."""
    results = evaluate.evaluate_metrics(spark, metrics)
    fact_results = evaluate.evaluate_facts(spark, facts)
    patches = refine.patched_ranges(results)
    patched = refine.apply_patches(metrics, patches)
    counts, splits = _categories(spark, metrics, results)
    actions = refine.refine_actions(results, counts)
    decided = patched.join(
        actions.select("catalogue_id", "pos", "action", "note"), ["catalogue_id", "pos"]
    ).withColumn("agent_notes", F.trim(F.concat_ws(" ", "agent_notes", F.when(F.col("action") == "annotate", F.col("note")))))
    columns = [f.name for f in METRIC_ROW.fields]
    kept = decided.where("action IN ('keep', 'annotate', 'report')").select(*columns)
    moved = refine.as_facts(decided.where("action = 'move_to_facts'"))
    new_metrics, new_facts = refine.choose_refined(
        kept.unionByName(splits), facts.unionByName(moved), patched, facts
    )
    new_metrics, new_facts = pin(new_metrics), pin(new_facts)
    issues = refine.needs_investigation(results, fact_results)
    return Refined(
        metrics=new_metrics,
        facts=new_facts,
        metric_results=evaluate.evaluate_metrics(spark, new_metrics),
        fact_results=evaluate.evaluate_facts(spark, new_facts),
        actions=actions,
        notes=actions.where("action = 'remove'").select("catalogue_id", "note"),
        summary=refine.refinement_summary(metrics, new_metrics, patches, issues),
    )


def pair_results(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries with their results, by position."""
    own = [c for c in results.columns if c not in entries.columns]
    return entries.join(results.select("catalogue_id", "pos", *own), ["catalogue_id", "pos"])


def catalogue_summary(metrics: DataFrame, facts: DataFrame, tables: DataFrame, results: DataFrame) -> DataFrame:
    """Headline counts per catalogue: documented tables, entries, cross-table entries, states."""
    crossing = F.count_if(F.size("tables_used") > 1)
    parts = [
        metrics.groupBy("catalogue_id").agg(
            F.count(F.lit(1)).alias("n_metrics"), crossing.alias("n_cross_metrics")
        ),
        facts.groupBy("catalogue_id").agg(F.count(F.lit(1)).alias("n_facts"), crossing.alias("n_cross_facts")),
        tables.groupBy("catalogue_id").agg(F.count(F.lit(1)).alias("n_tables")),
        scoring.status_counts(results).drop("n"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.join(part, "catalogue_id", "full")
    return rows.fillna(0)


def compare_catalogues(
    spark: SparkSession,
    databases: dict[str, dict[str, DataFrame]],
    sources: list[str],
    judged: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores with their rank per database, overall ranking, and catalogues without a
    database.

    ``databases`` maps a path or connection text to its tables; catalogues are matched
    by the stem of the connection they name. Statements run on the tables of their own
    database, which are registered before.
    """
    docs = pin(catalogues.read_catalogues(spark, catalogues.find_catalogues(spark, sources)))
    named = spark.createDataFrame([(s,) for s in databases], "source string")
    stems = {r["source"]: r["stem"] for r in named.select("source", db_stem(F.col("source")).alias("stem")).collect()}
    known = spark.createDataFrame([(s,) for s in stems.values()], "db_stem string")
    matched, unmatched = scoring.match_databases(catalogues.catalogue_index(docs), known)
    parts = []
    for source, tables in databases.items():
        register(tables)
        mine = docs.where(F.col("db_stem") == stems[source])
        metrics, facts = catalogues.metric_rows(mine), catalogues.fact_rows(mine)
        results, fact_results = evaluate.evaluate_catalogue(spark, metrics, facts)
        mentions = coverage.table_mentions(metrics, facts, catalogues.table_rows(mine))
        listed = spark.createDataFrame([(t,) for t in tables], "table_name string")
        parts.append(
            scoring.catalogue_scores(
                matched.where(F.col("db_stem") == stems[source]),
                metrics,
                results,
                fact_results,
                coverage.covered_count(listed, mentions),
                len(tables),
                judged,
            )
        )
    scores = pin(union_all(parts))
    return scoring.rank_within_database(scores), scoring.model_ranking(scores), unmatched
