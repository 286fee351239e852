"""Pairs of alike names by prefix-filtered joins: shared words first, then characters.

A name is the set of its words, ordered from the rarest to the most frequent. Two sets that
share at least ``a`` members also share ``l`` of them among their first ``size - a + l``, so
it is enough to join on single members (l = 1) or on pairs (l = 2) of these beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.similarity import jaccard, sequence_ratio, words
from metricloom.session import pin

# Fixed value: lowest score of an approximate match.
MIN_SCORE = 0.4

#: Word overlaps at which the search for a best name looks again, from high to low. What is
#: found above lets most requests out of the rounds below.
LEVELS = (0.75, 0.5, 0.0)
EPS = 1e-9


def _tagged(text: Column, kind: str) -> Column:
    """Members of a name: its distinct words, or its characters, the n-th equal one as its own."""
    if kind == "words":
        return words(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda o: o == c)).cast("string")),
    )


def _by_rarity(rows: DataFrame, key: str, counts: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``set``, the members of column ``key``, the rarest among the names first."""
    each = rows.select("c", key, F.explode(_tagged(F.col(key), kind)).alias("member"))
    ordered = (
        each.join(counts, ["c", "member"], "left")
        .groupBy("c", key)
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "member"))).alias("s"))
        .select("c", key, F.transform("s", lambda x: x["member"]).alias("set"))
    )
    return rows.join(ordered, ["c", key]).withColumn("size", F.size("set"))


def order_members(requests: DataFrame, names: DataFrame, kind: str = "words") -> tuple[DataFrame, DataFrame]:
    """Requests (c, q, …) and names (c, n, …), distinct each, with ``set`` and ``size``."""
    counts = (
        names.select("c", F.explode(_tagged(F.col("n"), kind)).alias("member"))
        .groupBy("c", "member")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    return pin(_by_rarity(requests, "q", counts, kind)), pin(_by_rarity(names, "n", counts, kind))


def _first(size: Column) -> Column:
    return F.slice("set", F.lit(1), size)


def _keys(own: Column, twos: Column) -> Column:
    """Members of a beginning as join keys: in pairs, or one by one."""
    pairs = F.flatten(
        F.transform(
            own,
            lambda a, i: F.transform(
                F.slice(own, i + 2, F.size(own)), lambda b: F.concat(a, F.lit("\u0001"), b)
            ),
        )
    )
    return F.when(twos, pairs).otherwise(own)


def _need(kind: str, least: Column, n: Column, m: Column) -> Column:
    """Members that two sets of these sizes have to share to be as alike as ``least``."""
    share = least / (1 + least) if kind == "words" else least / 2
    return F.greatest(F.ceil(share * (n + m) - EPS), F.lit(1)).cast("int")


def joined(requests: DataFrame, names: DataFrame, kind: str, lowest: float) -> DataFrame:
    """Candidate pairs, each once: (c, q, n) and the other columns of both sides.

    ``requests`` have ``least``, the similarity that a pair needs (Jaccard of words, twice the
    shared characters over all), at least ``lowest``. Every pair that reaches it is found.
    A request looks for each size of names by itself, so that no size weakens another.
    """
    longest = names.agg(F.max("size")).first()[0] or 0
    small = F.greatest(F.col("least"), F.lit(EPS))
    if kind == "words":
        low, high = F.col("size") * small, F.col("size") / small
        weakest = F.ceil(F.lit(lowest) * F.col("size") - EPS)
    else:
        low, high = F.col("size") * small / (2 - small), F.col("size") * (2 - small) / small
        weakest = F.ceil(F.lit(lowest / (2 - lowest)) * F.col("size") - EPS)
    low = F.greatest(F.ceil(low - EPS), F.lit(1)).cast("int")
    high = F.least(F.floor(F.least(high, F.lit(1e6)) + EPS), F.lit(longest)).cast("int")
    sizes = F.when(low <= high, F.sequence(low, high))
    wanted = requests.withColumn("other", F.explode(sizes)).withColumn(
        "need", _need(kind, F.col("least"), F.col("size"), F.col("other"))
    ).where(F.col("need") <= F.least("size", "other"))
    twos = F.col("need") >= 2
    begun = _first(F.col("size") - F.col("need") + F.when(twos, 2).otherwise(1))
    left = wanted.withColumn("key", F.explode(_keys(begun, twos)))
    most = F.greatest(weakest, F.lit(1)).cast("int")
    one, two = (_first(F.least(F.col("size") - most + k, F.col("size"))) for k in (1, 2))
    right = names.select(
        "c", "n", F.col("size").alias("other"), F.col("set").alias("others"),
        *[x for x in names.columns if x not in ("c", "n", "size", "set")],
        F.explode(F.concat(_keys(one, F.lit(False)), _keys(two, F.lit(True)))).alias("key"),
    )
    found = left.join(right, ["c", "other", "key"])
    return found.where(F.size(F.array_intersect("set", "others")) >= F.col("need")).dropDuplicates(["c", "q", "n"])


def _distinct(requests: DataFrame, names: DataFrame, within: str | None) -> tuple[DataFrame, DataFrame]:
    scope = (F.col(within) if within else F.lit("")).cast("string")
    scope = F.coalesce(scope, F.lit("")).alias("c")
    asked = requests.select(scope, F.lower(F.trim("request")).alias("q")).distinct()
    known = names.select(scope, F.lower("name").alias("n"), "name", "pos")
    first = known.groupBy("c", "n").agg(F.min(F.struct("pos", "name")).alias("m"))
    return asked, first.select("c", "n", "m.name", "m.pos")


def similar_by_words(requests: DataFrame, names: DataFrame, least: float, within: str | None = None) -> DataFrame:
    """All pairs whose word sets have a Jaccard similarity of ``least`` (above 0) or more:
    (request, name, shared, overlap) in lower case. Work follows the pairs that share rare words."""
    asked, known = _distinct(requests, names, within)
    asked, known = order_members(asked, known)
    pairs = joined(asked.withColumn("least", F.lit(float(least))), known, "words", least)
    return pairs.withColumn("overlap", jaccard(F.col("set"), F.col("others"))).where(
        F.col("overlap") >= least - EPS
    ).select(
        *([F.col("c").alias(within)] if within else []),
        F.col("q").alias("request"),
        F.col("n").alias("name"),
        F.size(F.array_intersect("set", "others")).cast("bigint").alias("shared"),
        "overlap",
    )


def best_names(requests: DataFrame, names: DataFrame) -> DataFrame:
    """The best name of each distinct request (c, q): (c, q, matched_name, score), where one
    scores ``MIN_SCORE``; ``names`` (c, n, name, pos) are distinct in (c, n).

    The score is the mean of word overlap and character ratio. A pair of overlap o scores
    (1 + o) / 2 at most, so a request that has scored s needs no pair below o = 2 s - 1.
    Rounds go down the ``LEVELS`` of overlap and leave requests behind as soon as no better
    pair can come. What is left without a common word needs a ratio of 0.8 or more, hence
    as large a share of common characters.
    """
    asked, known = order_members(requests, names)
    best = asked.select("c", "q", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("score"))
    above = 2.0
    for level in (*LEVELS, None):
        reach = 2 * F.greatest("score", F.lit(MIN_SCORE)) - 1
        # A pair below the level before scores less than (1 + level) / 2.
        still = best.where(reach < above) if level is not None else best.where(2 * F.col("score") <= 1)
        if level is not None:
            open_ = asked.join(still, ["c", "q"]).withColumn("least", F.greatest(reach, F.lit(level)))
            pairs = joined(open_.drop("pos", "name"), known, "words", level)
            pairs = pairs.withColumn("overlap", jaccard(F.col("set"), F.col("others"))).where(F.col("overlap") < above)
        else:
            by_chars, names_by_chars = order_members(still.select("c", "q", "score"), names, "chars")
            least = 2 * F.greatest("score", F.lit(MIN_SCORE))
            open_ = by_chars.withColumn("least", F.least(least, F.lit(1.0)))
            pairs = joined(open_, names_by_chars, "chars", 2 * MIN_SCORE)
            pairs = pairs.withColumn("overlap", jaccard(words(F.col("q")), words(F.col("n")))).where("overlap = 0")
        scored = pairs.select("c", "q", "n", "name", "pos", "score", "overlap").withColumn(
            "needed", 2 * F.greatest("score", F.lit(MIN_SCORE)) - F.col("overlap") - EPS
        )
        longer = F.length("q") + F.length("n")
        scored = scored.where(2 * F.least(F.length("q"), F.length("n")) >= F.col("needed") * longer - EPS)
        # Few bytes but much work a pair, so pairs are dealt out to all tasks.
        spark = requests.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = (
            scored.repartition(tasks, "c", "q", "n")
            .withColumn("score", (sequence_ratio("q", "n", "needed") + F.col("overlap")) / 2)
            .where(F.col("score") >= MIN_SCORE)
            .select("c", "q", "pos", "name", "score")
        )
        top = F.max_by(F.struct("pos", "name", "score"), F.struct("score", -F.col("pos")))
        best = pin(best.unionByName(found).groupBy("c", "q").agg(top.alias("m")).select("c", "q", "m.*"))
        above = level
    return best.where("name IS NOT NULL").select("c", "q", F.col("name").alias("matched_name"), "score")
