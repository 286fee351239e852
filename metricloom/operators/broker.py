"""Serving metrics and facts by exact or approximate name."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.coerce import to_value
from metricloom.functions.similarity import jaccard, sequence_ratio, words
from metricloom.operators.similar_names import MIN_SCORE, best_names
from metricloom.operators.skew import attach
from metricloom.session import pin
from metricloom.sources.catalogues import by_name
from metricloom.sources.tables import run_sql


def match_names(requests: DataFrame, names: DataFrame, within: str | None = None) -> DataFrame:
    """Best entry for each request: (request, matched_name, score), null without a match.

    ``names`` has (name, pos), one row per name. With ``within``, a column of both sides
    such as the catalogue, requests only meet names of the same value, and it is returned.
    An equal name (ignoring case) wins with score 1. Otherwise the score is the mean of
    character-sequence ratio and word overlap, and ``MIN_SCORE`` at least; candidates come
    from :func:`similar_names.best_names`, which loses no best name. Of equal scores the
    first position wins.
    """
    scope = F.coalesce((F.col(within) if within else F.lit("")).cast("string"), F.lit("")).alias("c")
    own = [F.col(within).alias("_within")] if within else []
    wanted = requests.select("request", scope, *own, F.lower(F.trim("request")).alias("q"))
    distinct = wanted.groupBy("c", "q").agg(F.count(F.lit(1)).alias("n_requests"))
    known = (
        names.select(scope, F.lower("name").alias("n"), "name", "pos")
        .groupBy("c", "n")
        .agg(F.min(F.struct("pos", "name")).alias("m"))
        .select("c", "n", "m.name", "m.pos")
    )
    exact = distinct.join(known, (distinct["c"] == known["c"]) & (F.col("q") == F.col("n"))).select(
        distinct["c"], "q", F.col("name").alias("matched_name"), F.lit(1.0).alias("score")
    )
    open_requests = distinct.join(exact, ["c", "q"], "left_anti").select("c", "q")
    best = best_names(open_requests, known)
    # One row per distinct request, read twice below.
    matched = pin(
        distinct.join(exact.unionByName(best), ["c", "q"], "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0))
        )
    )
    key = F.concat_ws("\u0001", "c", "q")
    found = attach(
        wanted.withColumn("k", key), matched.withColumn("k", key), "k", ["matched_name", "score"], "n_requests"
    ).drop("k", "q", "c")
    return found.withColumnRenamed("_within", within) if within else found


def normalised_series(df: DataFrame) -> DataFrame:
    """First two columns as (date, value): values coerced, null values dropped."""
    if len(df.columns) < 2:
        raise ValueError(f"query returned {len(df.columns)} column(s); expected at least 2 (date, value)")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    value = to_value(F.col("c1"), df.schema.fields[1].dataType)
    return plain.select(F.col("c0").cast("string").alias("date"), value.alias("value")).where(
        "value IS NOT NULL"
    )


def date_window(
    series: DataFrame, start: str | None = None, end: str | None = None, inclusive_end: bool = False
) -> DataFrame:
    """Rows within [start, end], compared as text against the YYYY-MM prefixes.

    By default a full date inside the end month lies beyond the prefix and is
    excluded; ``inclusive_end`` compares months instead.
    """
    if start:
        series = series.where(F.col("date") >= start[:7])
    if end:
        date = F.left("date", F.lit(7)) if inclusive_end else F.col("date")
        series = series.where(date <= end[:7])
    return series


def closest(entries: DataFrame, wanted: str):
    """The entry of one catalogue whose name scores best, the first of equal ones, with its
    score; None below ``MIN_SCORE``. One job over the names, no shuffle but the top-1."""
    scored = entries.withColumns({"_q": F.lit(wanted), "_n": F.lower("name")}).withColumn(
        "_overlap", jaccard(words(F.col("_q")), words(F.col("_n")))
    )
    least = 2 * MIN_SCORE - F.col("_overlap") - 1e-9
    score = (sequence_ratio("_q", "_n", least) + F.col("_overlap")) / 2
    best = scored.withColumn("_score", score).where(F.col("_score") >= MIN_SCORE)
    rows = best.orderBy(F.desc("_score"), "pos").take(1)
    return (rows[0], rows[0]["_score"]) if rows else None


class Broker:
    """Serves the entries of one catalogue."""

    def __init__(self, spark: SparkSession, metrics: DataFrame, facts: DataFrame) -> None:
        self.spark = spark
        self._metrics = by_name(metrics)
        self._facts = by_name(facts)

    def list_metrics(self) -> DataFrame:
        return self._metrics.select("name").orderBy("name")

    def list_facts(self) -> DataFrame:
        return self._facts.select("name").orderBy("name")

    def _find(self, name: str, entries: DataFrame, kind: str):
        """The single best entry row and its score."""
        wanted = name.lower().strip()
        equal = entries.where(F.lower("name") == wanted).orderBy("pos").take(1)
        if equal:
            return equal[0], 1.0
        found = closest(entries, wanted)
        if found is None:
            raise KeyError(f"The catalogue has no {kind} named like '{name}'")
        return found

    def fetch_with_info(
        self, metric_name: str, start: str | None = None, end: str | None = None, inclusive_end: bool = False
    ) -> tuple[DataFrame, dict]:
        """Series of a metric and what is known about it."""
        entry, score = self._find(metric_name, self._metrics, "metric")
        if score < 1.0:
            warnings.warn(
                f"'{metric_name}' is not a name here; taken for '{entry['name']}' (score {score:.2f})",
                UserWarning,
                stacklevel=3,
            )
        # The filter is part of the lazy plan; ordering comes last.
        series = date_window(normalised_series(run_sql(self.spark, entry["sql"])), start, end, inclusive_end)
        info = {
            "metric_name": entry["name"],
            "match_score": round(score, 3),
            "granularity": entry["granularity"] or "unknown",
            "unit": entry["unit"] or "",
            "confidence": entry["confidence"] or "",
            "agent_notes": entry["agent_notes"] or "",
        }
        return series.orderBy("date"), info

    def fetch(
        self, metric_name: str, start: str | None = None, end: str | None = None, inclusive_end: bool = False
    ) -> DataFrame:
        """Series (date, value) of the best matching metric, by date."""
        return self.fetch_with_info(metric_name, start, end, inclusive_end)[0]

    def query(self, fact_name: str) -> DataFrame:
        """Result of the best matching fact, as its statement returns it."""
        entry, _ = self._find(fact_name, self._facts, "fact")
        return run_sql(self.spark, entry["sql"])

    def describe(self, metric_name: str) -> DataFrame:
        entry, _ = self._find(metric_name, self._metrics, "metric")
        return self._metrics.where(F.col("name") == entry["name"])

    def describe_fact(self, fact_name: str) -> DataFrame:
        entry, _ = self._find(fact_name, self._facts, "fact")
        return self._facts.where(F.col("name") == entry["name"])
