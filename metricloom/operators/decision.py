"""The decision on each submission of a run: accepted, or sent back with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.text import tables_referenced
from metricloom.operators import gate
from metricloom.operators.coverage import REJECTION_CAP, _as_array, uncovered_pairs
from metricloom.operators.skew import attach, keep_first
from metricloom.schemas import TEXTS
from metricloom.session import pin

# The order of reasons. Those up to foreign_keys stand beside each other, but
# for too_early, which the first three leave out. The last three are looked at one by one,
# where nothing stands before them.
REASONS = (
    "tables_not_list", "bare_tables", "compressed", "too_early", "keys_absent", "empty_lists", "ghost_tables",
    "foreign_keys", "required_tables", "too_few_metrics", "item_rules",
)
LAST_JOINT = REASONS.index("foreign_keys")

REASON = "array<struct<rank:int,rule:string,detail:string>>"


def missing_pairs(attempts: DataFrame, metrics: DataFrame, pairs: DataFrame, cap: int) -> DataFrame:
    """Foreign-key pairs that send an attempt back: (submission_id, run, attempt, pair, nth).

    A pair that an attempt leaves out counts once for its run. The first ``cap`` attempts
    that leave it out are sent back for it; then it is waived for the rest of the run. So the
    fold over a run is a rank of its attempts for each pair, limited before it is shuffled.
    """
    ids = attempts.select(F.col("submission_id").alias("catalogue_id"))
    entries = metrics.select(F.col("submission_id").alias("catalogue_id"), "tables")
    left_out = uncovered_pairs(ids, entries, pairs, "tables").select(
        F.col("catalogue_id").alias("submission_id"), F.concat_ws("-", "from_table", "to_table").alias("shown"),
        F.array_sort(F.array("from_table", "to_table")).alias("pair"),
    )
    placed = left_out.join(attempts.select("submission_id", "run", "attempt"), "submission_id")
    nth = F.row_number().over(Window.partitionBy("run", "pair").orderBy("attempt"))
    return placed.withColumn("nth", nth).where(F.col("nth") <= cap)


def _texts(item: str, path: str) -> Column:
    listed = F.from_json(F.get_json_object(item, path), TEXTS)
    return F.coalesce(listed, F.array().cast("array<string>"))


def decide(
    attempts: DataFrame,
    foreign_keys: DataFrame,
    exempt: DataFrame | None = None,
    required: DataFrame | None = None,
    min_iterations: int = 0,
    min_metrics: int = 0,
    cap: int = REJECTION_CAP,
) -> DataFrame:
    """Decisions on the submissions of many runs: (run, attempt, submission_id, status,
    reasons, first_reason, waived).

    ``attempts`` has (submission_id, run, attempt, iteration, data): the documents that a run
    submitted, in order. A run ends with its first accepted attempt, later ones are
    ``closed``. ``foreign_keys`` (from_table, to_table) have to be joined by some metric's
    statement, unless a table of theirs is in ``exempt`` (table_name) or the pair was the
    reason ``cap`` times in the same run before: ``waived`` lists those pairs.
    ``required`` (table_name) have to be used by some metric.

    Documents are parsed a fixed number of times whatever the rules; the attempts of a run
    are never gathered, only its pairs and its first accepted attempt are.
    """
    from metricloom.operators.coverage import foreign_key_pairs

    attempts = pin(attempts.select("submission_id", "run", "attempt", "iteration", "data"))
    # Items and their rules are read in one pass over the documents.
    items = pin(gate.listed_items(attempts))
    read = pin(
        items.where(F.col("field").isin("measurable_metrics", "queryable_facts")).select(
            "submission_id", (F.col("field") == "measurable_metrics").alias("is_metric"), "idx",
            F.coalesce(F.get_json_object("item", "$.name"), F.lit("?")).alias("name"),
            F.coalesce(F.get_json_object("item", "$.sql"), F.lit("")).alias("sql"),
            F.transform(_texts("item", "$.tables_used"), F.lower).alias("used"),
        ).withColumn("tables", tables_referenced(F.col("sql")))
    )
    metrics = read.where("is_metric")

    def reasons(rows: DataFrame, rule: str | Column, detail: Column) -> DataFrame:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        rank = F.array_position(F.array(*map(F.lit, REASONS)), rule).cast("int") - 1
        return rows.select("submission_id", rank.alias("rank"), rule.alias("rule"), detail.alias("detail"))

    flag = F.coalesce(F.get_json_object("data", "$._compressed"), F.lit("false"))
    found = [
        reasons(gate.submission_gate(attempts), F.col("rule"), F.col("detail")),
        reasons(attempts.where(~flag.isin("false", "0", "", "[]", "{}")), "compressed", F.lit("")),
        reasons(
            attempts.where(F.col("iteration") < min_iterations), "too_early",
            F.concat_ws("/", F.col("iteration"), F.lit(min_iterations)),
        ),
    ]
    ghosts = F.array_sort(F.array_except("used", "tables"))
    ghostly = read.withColumn("ghosts", ghosts).where("size(ghosts) > 0")
    line = F.concat("name", F.lit(": "), F.array_join("ghosts", ","))
    found.append(_listed(reasons(ghostly, "ghost_tables", line)))
    missing = pin(missing_pairs(attempts, metrics, foreign_key_pairs(foreign_keys, exempt), cap))
    found.append(_listed(reasons(missing, "foreign_keys", F.col("shown"))))
    if required is not None:
        covered = metrics.select("submission_id", F.explode("used").alias("table")).distinct()
        wanted = attempts.select("submission_id", F.explode(_as_array(required, "table_name")).alias("needed"))
        absent = wanted.withColumn("table", F.lower("needed")).join(covered, ["submission_id", "table"], "left_anti")
        found.append(_listed(reasons(absent, "required_tables", F.col("needed"))))
    if min_metrics > 0:
        counts = metrics.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"))
        counted = attempts.select("submission_id").join(counts, "submission_id", "left").fillna(0, ["n"])
        found.append(reasons(counted.where(F.col("n") < min_metrics), "too_few_metrics", F.col("n").cast("string")))
    broken = gate.broken_rules(items)
    line = F.concat("field", F.lit("["), F.col("idx").cast("string"), F.lit("]."), "rule")
    found.append(_listed(reasons(broken, "item_rules", line)))

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranked = every.groupBy("submission_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "rule", "detail"))).cast(REASON).alias("all")
    )
    early = REASONS.index("too_early")
    joint = F.filter(
        "all",
        lambda r: (r["rank"] <= LAST_JOINT) & ((r["rank"] != early) | ~F.exists("all", lambda x: x["rank"] < early)),
    )
    kept = F.when(F.size(joint) > 0, joint).otherwise(F.slice("all", 1, 1))
    decided = pin(
        attempts.drop("data")
        .join(ranked, "submission_id", "left")
        .withColumn("reasons", F.coalesce(kept, F.array().cast(REASON)))
        .drop("all")
        .withColumn("run_key", F.col("run").cast("string"))
    )
    ends = keep_first(decided.where("size(reasons) = 0").select("run_key", "attempt"), ["run_key"], ["attempt"])
    gone = (
        missing.where(F.col("nth") == cap)
        .groupBy(F.col("run").cast("string").alias("run_key"))
        .agg(F.collect_list(F.struct("shown", F.col("attempt").alias("after"))).alias("gone"))
    )
    sizes = decided.groupBy("run_key").agg(F.count(F.lit(1)).alias("size"))
    of_run = sizes.join(ends.withColumnRenamed("attempt", "end"), "run_key", "left").join(gone, "run_key", "left")
    known = attach(decided, pin(of_run), "run_key", ["end", "gone"], "size")
    waived = F.array_sort(
        F.transform(F.filter("gone", lambda g: g["after"] < F.col("attempt")), lambda g: g["shown"])
    )
    status = (
        F.when(F.col("attempt") > F.col("end"), "closed").when(F.size("reasons") == 0, "accepted").otherwise("rejected")
    )
    return known.select(
        "run", "attempt", "submission_id", status.alias("status"),
        F.transform("reasons", lambda r: F.struct(r["rule"].alias("rule"), r["detail"].alias("detail"))).alias("reasons"),
        F.get("reasons", F.lit(0))["rule"].alias("first_reason"),
        F.coalesce(waived, F.array().cast("array<string>")).alias("waived"),
    )


def _listed(reasons: DataFrame) -> DataFrame:
    """Several details of one reason as a list."""
    return reasons.groupBy("submission_id", "rank", "rule").agg(
        F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("detail")
    )
