"""Scores of whole catalogues and rankings of their authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.json_text import clean_answer, json_kind, scored_items
from metricloom.functions.periods import span_months
from metricloom.operators.skew import attach, rank_rounded, upper_median
from metricloom.session import pin


def match_databases(catalogues: DataFrame, databases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogues with a database of the same stem, and those without."""
    stems = databases.select("db_stem").distinct()
    return (
        catalogues.join(stems, "db_stem", "left_semi"),
        catalogues.join(stems, "db_stem", "left_anti"),
    )


def judge_scores(responses: DataFrame) -> DataFrame:
    """Scores found in free-text answers: (catalogue_id, name, score, reason). The last
    answer about a name counts; a missing score is 3."""
    # Step by step, so that each answer is cleaned and parsed once.
    cleaned = responses.select("catalogue_id", "batch", clean_answer(F.col("text")).alias("t"))
    typed = cleaned.withColumn("k", json_kind(F.col("t")))
    rows = typed.select(
        "catalogue_id", "batch", F.posexplode(scored_items(F.col("t"), F.col("k"))).alias("i", "item")
    )
    last = F.max_by(F.struct(F.coalesce("item.score", F.lit(3.0)).alias("score"),
                             F.coalesce("item.reason", F.lit("")).alias("reason")),
                    F.struct("batch", "i"))
    return (
        rows.where("item.name IS NOT NULL")
        .groupBy("catalogue_id", F.col("item.name").alias("name"))
        .agg(last.alias("s"))
        .select("catalogue_id", "name", "s.score", "s.reason")
    )


def attach_scores(metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics with their semantic score by name, null where none was given."""
    return metrics.join(
        scores.select("catalogue_id", "name", F.col("score").alias("semantic")),
        ["catalogue_id", "name"],
        "left",
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _mean_span() -> Column:
    span = span_months(F.col("time_range.start"), F.col("time_range.end"))
    return F.coalesce(F.avg(span), F.lit(0.0))


def proposal_spans(metrics: DataFrame) -> DataFrame:
    """Mean declared months per catalogue; blank or malformed ranges are skipped."""
    return metrics.groupBy("catalogue_id").agg(_mean_span().alias("avg_span_months"))


def catalogue_scores(
    catalogues: DataFrame,
    metrics: DataFrame,
    metric_results: DataFrame,
    fact_results: DataFrame,
    covered: DataFrame,
    n_db_tables: int,
    judged: DataFrame | None = None,
) -> DataFrame:
    """One row of scores per catalogue.

    ``catalogues`` has (catalogue_id, label, run_index, db_stem), ``covered`` has
    (catalogue_id, n_covered_tables), ``judged`` the semantic scores.
    """
    counts = metric_results.groupBy("catalogue_id").agg(
        F.count(F.lit(1)).alias("n_metrics"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")],
        F.count_if(F.col("duplicate_of") != "").alias("n_duplicates"),
        F.count_if(F.col("error").contains("constant_values")).alias("n_constants"),
        F.count_if(F.col("confidence") == "high").alias("n_high"),
        F.count_if(F.col("sql_ok") & F.col("date_range_ok")).alias("n_date_ok"),
    )
    declared = metrics.groupBy("catalogue_id").agg(
        F.count_if(F.size("tables_used") > 1).alias("n_joins"), _mean_span().alias("avg_span_months")
    )
    facts = fact_results.groupBy("catalogue_id").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("status") == "PASS").alias("n_facts_pass")
    )
    median = upper_median(metric_results.where("sql_ok"), ["catalogue_id"], "n_rows", "median_rows")
    rows = catalogues.select("catalogue_id", "label", "run_index", "db_stem")
    for part in (counts, declared, facts, median, covered):
        rows = rows.join(part, "catalogue_id", "left")
    rows = rows.fillna(0).withColumn("n_db_tables", F.lit(n_db_tables).cast("bigint"))
    n = F.col("n_metrics")
    pass_rate = _share(F.col("n_pass"), n)
    coverage = _share(F.col("n_covered_tables"), F.col("n_db_tables"))
    noise = _share(F.col("n_duplicates") + F.col("n_constants"), n)
    composite = pass_rate * coverage * (1 - noise) * 100
    rows = rows.withColumns({"raw_composite": composite})
    if judged is None:
        rows = rows.withColumn("semantic_score", F.lit(None).cast("double"))
    else:
        means = judged.groupBy("catalogue_id").agg(F.bround(F.avg("score"), 2).alias("semantic_score"))
        rows = rows.join(means, "catalogue_id", "left")
    return rows.select(
        "catalogue_id",
        "label",
        "run_index",
        "db_stem",
        "n_metrics",
        "n_pass",
        "n_warn",
        "n_fail",
        "n_duplicates",
        "n_constants",
        "n_joins",
        "n_facts",
        "n_facts_pass",
        "n_covered_tables",
        "n_db_tables",
        F.bround(pass_rate, 4).alias("pass_rate"),
        F.bround(coverage, 4).alias("coverage_rate"),
        F.bround(noise, 4).alias("noise_ratio"),
        F.bround(_share(F.col("n_high"), n), 4).alias("conf_rate"),
        F.bround(_share(F.col("n_date_ok"), n), 4).alias("date_ok_rate"),
        F.bround("median_rows", 1).alias("median_rows"),
        F.bround("avg_span_months", 1).alias("avg_span_months"),
        F.bround("raw_composite", 1).alias("composite"),
        "semantic_score",
        F.bround(F.col("raw_composite") * (F.col("semantic_score") / 5.0), 1).alias("combined"),
    )


def rank_within_database(scores: DataFrame) -> DataFrame:
    """Rank per database: by combined score where any catalogue has one, else by composite."""
    scores = pin(scores)
    judged = scores.groupBy("db_stem").agg(
        F.bool_or(F.col("semantic_score").isNotNull()).alias("has_judge"), F.count(F.lit(1)).alias("n")
    )
    marked = attach(scores, judged, "db_stem", ["has_judge"], "n")
    marked = marked.withColumn(
        "ranked_by", F.when(F.col("has_judge"), F.col("combined")).otherwise(F.col("composite"))
    )
    return rank_rounded(marked, ["db_stem"], "ranked_by").drop("has_judge")


def model_ranking(scores: DataFrame) -> DataFrame:
    """Mean scores per author over its catalogues, nulls ignored, and the overall rank."""
    scores = pin(scores)
    means = scores.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_dbs"),
        F.bround(F.avg("composite"), 1).alias("score"),
        F.bround(F.avg("semantic_score"), 1).alias("semantic"),
        F.bround(F.avg("combined"), 1).alias("combined"),
    )
    any_judged = scores.agg(F.bool_or(F.col("combined").isNotNull())).scalar()
    by = F.when(any_judged, F.col("combined")).otherwise(F.col("score"))
    return rank_rounded(means.withColumn("ranked_by", by), [], "ranked_by")


def status_counts(results: DataFrame) -> DataFrame:
    """PASS, WARN and FAIL counts per catalogue."""
    return results.groupBy("catalogue_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")],
    )
