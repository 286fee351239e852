"""Personal data in texts: fixed formats, and candidates that boosted trees select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import pack, unpack
from metricloom.session import pin

# The formats of the contract, in the order of their kinds. Their groups are
# written without backtracking, so that texts of any length are read in one pass: no other
# way to read a match exists, and a run of characters that fails at its start fails inside.
FORMATS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(FORMATS)
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)
#: High-recall generators; their spans may overlap those above and each other.
GENERATORS = {
    "number": r"[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "address": r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++){1,8}",
}
_NEEDS = {"email": "@", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CUES = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|address|ip)[\W_]*$"
PRECISION = 0.95
TREES, DEPTH = 10, 3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of 1 to 19 digits."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        v = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), n - 1)
    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike("^" + r"\.".join([_OCTET] * 4) + "$"))
        .when(kind == "card", n.between(*CARD_DIGITS) & _luhn(digits))
        .when(kind == "phone", n.between(*PHONE_DIGITS))
        .otherwise(F.lit(False))
    )


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """(kind, order, gap before, match, left and right context) of each match in order.

    The text is split at its matches, so the gaps' lengths give the positions.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = F.struct(gaps.alias("gaps"), found.alias("found"))

    def each(x: Column) -> Column:
        return F.transform(
            x["found"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("order"),
                F.length(x["gaps"][i]).alias("gap"),
                m.alias("match"),
                F.right(x["gaps"][i], F.lit(32)).alias("before"),
                F.left(x["gaps"][i + 1], F.lit(8)).alias("after"),
            ),
        )

    # The lambda's argument is computed once, not once for each match.
    whole = F.transform(F.array(one), each)[0]
    needed = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[0-9]")
    if kind == "address":
        needed = text.contains("@") | text.rlike(r"[(\[]at[)\]]")
    return F.when(needed, whole)


def _features(spans: DataFrame) -> list[Column]:
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    digits = _digits(m)

    def count(chars: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, chars, ""))

    flags = [
        F.col("kind") == "number",
        F.col("kind") == "address",
        m.startswith("+"),
        before.endswith("+"),
        _luhn(digits),
        m.rlike(r"^[0-9]{3,4}(?:[\x20-]?[0-9]{4}){3}$"),
        m.rlike(r"\)\x20?[0-9]{3}[\x20.-]?[0-9]{4}$"),
        before.rlike(r"(?:^|\s)$"),
        before.rlike(r"[A-Za-z]$"),
        after.rlike(r"^[A-Za-z]"),
        after.rlike(r"^(?:\s|$)"),
        before.rlike(CUES),
    ]
    counts = [
        F.length(m),
        F.length(digits),
        count(r"[A-Za-z]"),
        count(r"\x20"),
        count(r"\."),
        count("-"),
        count(r"[()]"),
        F.length(F.regexp_extract(m, "^[0-9]+", 0)),
        F.length(F.regexp_extract(m, "[0-9]+$", 0)),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in flags + counts]


def _boosted(candidates: DataFrame, precision: float) -> DataFrame | None:
    """(row, kind, start, end) of the candidates that the trees select; None without a model.

    Candidates teach the trees by themselves: one that meets a valid span of a fixed format
    is personal data, any other is taken for none. Half of all candidates fits the trees,
    the other half calibrates the threshold: the least score above which ``precision`` of it
    is personal data. Candidates with equal features are one row weighted by their number,
    so no candidate is left out and the rows grow with the forms, not with the texts.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rated = pin(
        candidates.select(
            "row", "kind", "start", "end", "label", "hash", F.array(*_features(candidates)).alias("values")
        )
    )
    forms = rated.groupBy((F.col("hash") % 2 == 0).alias("fit"), "label", "values").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    known = pin(forms).withColumn("features", array_to_vector("values"))
    classes = {(r["fit"], r["label"]) for r in known.select("fit", "label").distinct().collect()}
    if len(classes) < 4:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, weightCol="n")
    model = trees.fit(known.where("fit").select("features", "label", "n"))
    score = F.floor(vector_to_array("probability")[1] * 200).cast("int")
    levels = (
        model.transform(known.where("NOT fit"))
        .groupBy(score.alias("level"))
        .agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
        .orderBy(F.desc("level"))
        .collect()  # at most 201 levels
    )
    good = n = 0.0
    least = None
    for r in levels:
        good, n = good + r["good"], n + r["n"]
        if good >= precision * n:
            least = r["level"]
    if least is None:
        return None
    # Candidates on a format's span are found already.
    open_ = rated.where("label = 0").withColumn("features", array_to_vector("values"))
    return model.transform(open_).where(score >= least).select("row", "kind", "start", "end")


def find_personal_data(
    docs: DataFrame, text_column: str = "text", precision: float = PRECISION
) -> DataFrame:
    """The input's columns but the text, with ``base`` and ``found``: arrays of
    (kind, start, end) by kind and start, in characters, the end exclusive.

    ``base`` has the fixed formats, leftmost and without overlaps per kind, matches that
    fail their check dropped. ``found`` has the generators' candidates that boosted trees
    select by format and context; none overlaps a base span.

    Null and empty texts have no spans, repeated rows come back each, input columns named
    like an output are replaced. Without candidates of both classes nothing is added to the
    base. Texts are read whole, once, and stay where they are; matches with their contexts
    are all that is shuffled, by row, so that only one text's matches meet.
    """
    row, names = pack(docs, [text_column, "base", "found"])
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    kinds = {**FORMATS, **GENERATORS}
    held = docs.select(row.alias("_row"), text.alias("_text"))
    arrays = [_matches(F.col("_text"), k, p) for k, p in kinds.items()]
    scanned = pin(
        held.select(
            "_row", F.monotonically_increasing_id().alias("_id"), F.array(*arrays).alias("_all")
        )
    )
    each = scanned.select("_id", F.explode("_all").alias("m")).select(
        F.col("_id").alias("row"), F.explode("m").alias("m")
    ).select("row", "m.*")
    in_order = Window.partitionBy("row", "kind").orderBy("order").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(in_order)).select(
        "row", "kind", "match", "before", "after",
        (F.col("end") - F.length("match")).cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        _valid(F.col("kind"), F.col("match")).alias("valid"),
    )
    by_start = Window.partitionBy("row").orderBy("start", "end", "kind")
    past = by_start.rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_start.rowsBetween(0, Window.unboundedFollowing)
    met = (F.max(F.when(F.col("valid"), F.col("end"))).over(past) > F.col("start")) | (
        F.min(F.when(F.col("valid"), F.col("start"))).over(ahead) < F.col("end")
    )
    placed = pin(placed.withColumn("met", F.coalesce(met, F.lit(False))))
    candidates = placed.where(F.col("kind").isin(*GENERATORS)).select(
        "*",
        F.col("met").cast("double").alias("label"),
        # Equal matches in equal contexts fall into the same half.
        F.abs(F.xxhash64("match", "before") % 1_000_003).alias("hash"),
    )
    base = placed.where("valid").select("row", "kind", "start", "end", F.lit(True).alias("fixed"))
    chosen = _boosted(candidates, precision)
    if chosen is not None:
        base = base.unionByName(chosen.withColumn("fixed", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    spans = base.groupBy(F.col("row").alias("_id")).agg(
        F.array_sort(
            F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "fixed"))
        ).alias("_spans")
    )

    def part(fixed: bool) -> Column:
        own = F.filter("_spans", lambda s: s["fixed"] if fixed else ~s["fixed"])
        listed = F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.coalesce(listed, F.array().cast("array<struct<kind:string,start:int,end:int>>"))

    return scanned.join(spans, "_id", "left").select(
        *unpack(names), part(True).alias("base"), part(False).alias("found")
    )
