"""Tokens of the last minute over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metricloom.operators.skew import keep_first
from metricloom.operators.usage import WINDOW_SECONDS

OUT = "session long, us long, n_calls long, tokens long, used long"
STATE = "us array<long>, n_calls array<long>, tokens array<long>"


def stream_trailing_tokens(
    calls: DataFrame, seconds: int = WINDOW_SECONDS, delay_seconds: int = 120
) -> DataFrame:
    """Running results of :func:`usage.trailing_tokens` over a stream of (session, ts,
    output_tokens): a row for each instant of a session, again whenever a later arrival
    changes it. The last row of an instant is final.

    A session keeps its instants of the last ``seconds`` and of the ``delay_seconds`` that a
    call may come late, one entry an instant; an event-time timer takes them away when the
    watermark has passed them, also where no call comes any more. Later calls are dropped by
    the watermark.
    """
    width, slack = seconds * 1_000_000, delay_seconds * 1_000_000

    def fold(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        known = {u: [n, t] for u, n, t in zip(*state.get, strict=True)} if state.exists else {}
        changed: list[int] = []
        if not state.hasTimedOut:
            for batch in batches:
                for us, n, tokens in zip(batch["us"], batch["n_calls"], batch["tokens"], strict=True):
                    entry = known.setdefault(int(us), [0, 0])
                    entry[0] += int(n)
                    entry[1] += int(tokens)
                    changed.append(int(us))
        mark = state.getCurrentWatermarkMs() * 1000
        if changed:
            yield _used(key[0], known, sorted(set(changed)), width)
        # A call may still arrive at the watermark and sees what was in use a window before.
        kept = {u: v for u, v in sorted(known.items()) if u > mark - width - slack}
        if kept:
            state.update((list(kept), [v[0] for v in kept.values()], [v[1] for v in kept.values()]))
            state.setTimeoutTimestamp(max(max(kept) + width + slack, mark + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()

    instants = (
        calls.where("output_tokens > 0")
        .withWatermark("ts", f"{delay_seconds} seconds")
        .select(
            F.col("session").cast("long").alias("session"),
            "ts",
            F.unix_micros("ts").alias("us"),
            F.lit(1).cast("long").alias("n_calls"),
            F.col("output_tokens").cast("long").alias("tokens"),
        )
    )
    return instants.groupBy("session").applyInPandasWithState(
        fold, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def _used(session: int, known: dict, changed: list[int], width: int) -> pd.DataFrame:
    """Rows of the instants that a change reaches: those up to a window after it."""
    times = sorted(known)
    rows, begin, total = [], 0, 0
    ahead, latest = iter(changed), None
    change = next(ahead, None)
    for us in times:
        total += known[us][1]
        while times[begin] <= us - width:
            total -= known[times[begin]][1]
            begin += 1
        while change is not None and change <= us:
            latest, change = change, next(ahead, None)
        if latest is not None and us < latest + width:
            rows.append((session, us, known[us][0], known[us][1], total))
    return pd.DataFrame(rows, columns=["session", "us", "n_calls", "tokens", "used"])


def final_tokens(
    spark: SparkSession, folder: str, limit: int, expected: int = 0
) -> DataFrame:
    """The last row of each instant that :func:`calls.run_to_files` has left in ``folder``, in
    the columns of :func:`usage.trailing_tokens`."""
    updates = spark.read.option("recursiveFileLookup", True).parquet(folder)
    rows = keep_first(updates, ["session", "us"], [F.desc("batch_id")])
    return rows.select(
        "session",
        F.timestamp_micros("us").alias("ts"),
        "n_calls",
        "tokens",
        "used",
        (F.lit(limit) - F.col("used")).alias("headroom"),
        (F.col("used") + expected > limit).alias("over_limit"),
    )
