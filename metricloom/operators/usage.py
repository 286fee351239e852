"""Analytics over a log of metered calls: prices, cost, totals, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.skew import attach
from metricloom.session import pin

# Price per million tokens of an unknown model, and cache price factors.
DEFAULT_PRICE = {"input": 3.00, "output": 15.00, "cache_write": 3.75, "cache_read": 0.30}
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.10

PRICES = ["input", "output", "cache_write", "cache_read"]

WINDOW_SECONDS = 60


def resolve_prices(models: DataFrame, book: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Price of each model id in ``models``.

    Tried in turn: the id itself, the first book entry that starts with it, then both
    again for the id without its provider, the fallback table, a default. Prefixes
    are matched by equality on the prefixes of the book's keys.
    """
    ids = models.select("model").distinct()
    bare = F.when(F.instr("model", "/") > 0, F.expr("substring(model, instr(model, '/') + 1)")).otherwise(
        F.col("model")
    )
    lookups = ids.select(
        "model",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("step"), F.col("model").alias("id")),
                F.struct(F.lit(2).alias("step"), bare.alias("id")),
            )
        ).alias("l"),
    ).select("model", "l.step", "l.id")
    price = F.struct(*PRICES)
    keys = book.select(
        F.col("model").alias("book_model"),
        "pos",
        price.alias("price"),
        F.explode(F.sequence(F.lit(0), F.length("model"))).alias("size"),
    ).select("book_model", "pos", "price", F.expr("left(book_model, size)").alias("id"))
    hits = lookups.join(keys, "id").select(
        "model",
        (F.col("step") + F.when(F.col("book_model") == F.col("id"), 0).otherwise(1)).alias("step"),
        "pos",
        "price",
    )
    if fallback is not None:
        fixed = fallback.select(F.col("model").alias("id"), "pos", price.alias("price"))
        hits = hits.unionByName(
            lookups.where("step = 2")
            .join(fixed, "id")
            .select("model", F.lit(4).alias("step"), "pos", "price")
        )
    best = hits.groupBy("model").agg(F.min_by("price", F.struct("step", "pos")).alias("price"))
    default = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_PRICE.items()])
    return (
        ids.join(best, "model", "left")
        .withColumn("is_default", F.col("price").isNull())
        .withColumn("price", F.coalesce("price", default))
        .select("model", "price.*", "is_default")
    )


def call_costs(calls: DataFrame, book: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Calls with their cost. A model that most calls use is priced without moving them."""
    used = calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"))
    prices = resolve_prices(used, book, fallback).join(used, "model")
    priced = attach(calls, prices, "model", [*PRICES, "is_default"], "n_calls")
    write = F.coalesce("cache_write", F.col("input") * CACHE_WRITE_FACTOR)
    read = F.coalesce("cache_read", F.col("input") * CACHE_READ_FACTOR)
    cost = (
        F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")
    ) / 1_000_000
    cost = cost + F.col("cache_write_tokens") * write / 1_000_000
    cost = cost + F.col("cache_read_tokens") * read / 1_000_000
    return priced.withColumn("cost", cost).drop(*PRICES)


def session_totals(costed: DataFrame, context_window: int = 0) -> DataFrame:
    """Totals and per-call averages per session; token averages are whole numbers."""
    tokens = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]
    rows = costed.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_calls"),
        *[F.sum(t).alias(t) for t in tokens],
        F.sum("cost").alias("total_cost"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    n = F.col("n_calls")
    elapsed = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(
        F.col("first_ts").cast("timestamp"))) / 1_000_000
    cached = F.floor((F.col("cache_write_tokens") + F.col("cache_read_tokens")) / n)
    rows = (
        rows.withColumn("avg_input", F.floor(F.col("input_tokens") / n))
        .withColumn("avg_output", F.floor(F.col("output_tokens") / n))
        .withColumn("avg_cost", F.col("total_cost") / n)
        .withColumn("calls_per_minute", F.when(elapsed > 0, n / elapsed * 60).otherwise(0.0))
    )
    if context_window > 0:
        rows = rows.withColumn("context_pct", (F.col("avg_input") + cached) / context_window * 100)
    return rows.drop("first_ts", "last_ts")


def calls_per_minute(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls per aligned minute. Works on a batch and on a watermarked stream alike."""
    return (
        calls.groupBy(*keys, F.window("ts", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_calls"), F.sum("output_tokens").alias("tokens"))
        .select(*keys, F.col("w.start").alias("minute"), "n_calls", "tokens")
    )


def _at(row: str, until: str) -> Window:
    """Rows of a session's bucket from one place to another, by time."""
    ends = {"first": Window.unboundedPreceding, "now": Window.currentRow, "last": Window.unboundedFollowing}
    return Window.partitionBy("session", "bucket").orderBy("us").rangeBetween(ends[row], ends[until])


def greedy_minutes(calls: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Windows of a session that restart at the first call ``seconds`` or more after the last
    start: (session, start, n_calls, tokens). The first window starts with the first call.

    Every call points at the call that would start the next window after it. From a
    session's first call the starts are found by pointer jumping: a round doubles how far the
    pointers reach, so rounds grow with the logarithm of the windows, and joins are by
    session and instant, so one busy session spreads over all tasks. Ordered work happens in
    buckets of one window length, and once over a session's buckets, which the calendar
    bounds.
    """
    width = seconds * 1_000_000
    instants = pin(
        calls.groupBy("session", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(
            F.count(F.lit(1)).alias("n_calls"), F.sum("output_tokens").alias("tokens")
        )
    )

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.floor(F.col("us") / width))

    none = F.lit(None).cast("bigint")
    seekers = instants.select("session", (F.col("us") + width).alias("us"), F.col("us").alias("origin"), none.alias("call"))
    points = bucketed(seekers.unionByName(instants.select("session", "us", none.alias("origin"), F.col("us").alias("call"))))
    # The first call at or after a point, in its own bucket or the next one that has calls.
    near = points.withColumn("near", F.min("call").over(_at("now", "last"))).where("origin IS NOT NULL")
    ahead = Window.partitionBy("session").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    later = points.groupBy("session", "bucket").agg(F.min("call").alias("first")).select(
        "session", "bucket", F.min("first").over(ahead).alias("later")
    )
    jumps = pin(
        near.join(later, ["session", "bucket"])
        .select("session", F.col("origin").alias("us"), F.coalesce("near", "later").alias("to"))
        .where("to IS NOT NULL")
    )
    heads = instants.groupBy("session").agg(F.min("us").alias("us"))
    starts = pin(heads)
    # Only calls that some call points at, and the first ones, can be starts.
    reached = jumps.select("session", F.col("to").alias("us")).union(heads).distinct()
    jumps = pin(jumps.join(reached, ["session", "us"], "left_semi"))
    while True:
        found = starts.join(jumps, ["session", "us"]).select("session", F.col("to").alias("us"))
        grown = pin(starts.union(found).distinct())
        if grown.count() == starts.count():
            break
        starts = grown
        on = jumps.select("session", F.col("us").alias("to"), F.col("to").alias("beyond"))
        jumps = pin(jumps.join(on, ["session", "to"]).select("session", "us", F.col("beyond").alias("to")))
    # A call lies in the window of the last start before it, in its bucket or the one before.
    begun = bucketed(starts.withColumn("start", F.col("us"))).withColumn(
        "bucket", F.explode(F.array("bucket", F.col("bucket") + 1))
    )
    each = bucketed(instants).unionByName(begun, allowMissingColumns=True)
    placed = each.withColumn("start", F.max("start").over(_at("first", "now"))).where("n_calls IS NOT NULL")
    return (
        placed.groupBy("session", "start")
        .agg(F.sum("n_calls").alias("n_calls"), F.sum("tokens").alias("tokens"))
        .withColumn("start", F.timestamp_micros("start"))
    )


def trailing_tokens(
    calls: DataFrame, limit: int, expected: int = 0, seconds: int = WINDOW_SECONDS, span: int = 10
) -> DataFrame:
    """Output tokens of the last ``seconds`` at each instant of a session, and whether
    ``expected`` more would exceed ``limit``. Calls exactly ``seconds`` old are out.

    Calls of one instant are summed first. Each then adds its tokens when it happens and
    takes them away when it leaves the window, so a plain running sum gives what is in
    use, at a cost that does not grow with the calls in a window. Time is cut into
    buckets of ``span`` windows, each with the tail of the bucket before it, so a busy
    session is spread over as many tasks as it has buckets.
    """
    width = seconds * 1_000_000
    size = width * span
    instants = (
        calls.where("output_tokens > 0")
        .groupBy("session", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        .agg(F.sum("output_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_calls"))
    )
    bucket = F.floor(F.col("us") / size)
    needed_next = F.pmod("us", F.lit(size)) > size - width
    placed = instants.withColumn(
        "bucket",
        F.explode(F.when(needed_next, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))),
    )
    enters = F.struct(
        "us", F.col("tokens").alias("change"), "tokens", "n_calls", (bucket == F.col("bucket")).alias("shown")
    )
    leaves = F.struct(
        (F.col("us") + width).alias("us"), (-F.col("tokens")).alias("change"), "tokens", "n_calls",
        F.lit(False).alias("shown"),
    )
    changes = placed.select("session", "bucket", F.inline(F.array(enters, leaves)))
    until_now = (
        Window.partitionBy("session", "bucket")
        .orderBy("us")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    used = changes.withColumn("used", F.sum("change").over(until_now)).where("shown")
    return used.select(
        "session",
        F.timestamp_micros("us").alias("ts"),
        "n_calls",
        "tokens",
        "used",
        (F.lit(limit) - F.col("used")).alias("headroom"),
        (F.col("used") + expected > limit).alias("over_limit"),
    )
