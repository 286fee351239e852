"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import pack, unpack
from metricloom.session import pin

VNODES = 64
RING = 2**32


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes, ascending, and their shards. A shard's nodes depend on
    its own number only, so one shard more leaves all others where they are."""
    nodes = sorted(
        (xxhash.xxh64_intdigest(f"{shard}/{v}") % RING, shard)
        for shard in range(shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes])


def limits(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: exact shares for no slack, else the mean and the slack."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(np.ceil(rows * (1 + slack) / shards))] * shards


def place(loads: dict[int, int], owners: np.ndarray, most: list[int]) -> list[tuple]:
    """Runs (arc, from, to, shard, first slot) of the rows of each arc, by rank.

    An arc's rows go to the shard of its node as long as that has room. What is left goes
    on clockwise, from node to node, to the first shards with room.
    """
    room, slots, runs, left = list(most), [0] * len(most), [], []

    def give(arc: int, at: int, n: int, shard: int) -> None:
        runs.append((arc, at, at + n, shard, slots[shard]))
        slots[shard] += n
        room[shard] -= n

    for arc in sorted(loads):
        own = int(owners[arc])
        if n := min(loads[arc], room[own]):
            give(arc, 0, n, own)
        if n < loads[arc]:
            left.append((arc, n))
    for arc, at in left:
        for step in range(1, len(owners)):
            if at == loads[arc]:
                break
            shard = int(owners[(arc + step) % len(owners)])
            if n := min(loads[arc] - at, room[shard]):
                give(arc, at, n, shard)
                at += n
    return runs


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    ties: list[Column] | None = None,
    vnodes: int = VNODES,
    slack: float = 0.0,
) -> DataFrame:
    """The input with ``shard`` and ``slot``, which has no gaps within a shard.

    A row's id hashes to a place on the ring and belongs to the next virtual node
    clockwise. A shard takes (1 + ``slack``) of the mean at most; rows beyond that go on
    clockwise to the next shard with room. Without slack all shares are exact, so counts are
    at most one apart. More slack moves fewer rows when a shard is added.

    Rows of an arc rank by a hash of id and ``ties`` and then by these values, so the
    result depends on the rows alone; only rows equal in all of them may swap their slots.
    Rows of one id (or null ids) share a place and may fill several shards. An empty input
    gives an empty result. Input columns named ``shard`` or ``slot`` are replaced.

    Rows move once, in a range shuffle whose last key is unique, so that no id or copy is
    too large for a task. The driver gets a count for each task and arc, no row.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for place_ in series:
            yield pd.Series(np.searchsorted(places, place_.to_numpy()) % len(places), dtype="int32")

    key = F.col(f"`{id_column}`")
    row, names = pack(docs, ["shard", "slot"])
    ties = ties or []
    keyed = docs.select(
        row.alias("_row"),
        F.shiftrightunsigned(F.xxhash64(key), 32).alias("_place"),
        F.struct(
            F.xxhash64(key, *ties).alias("h"),
            key.alias("id"),
            *[t.alias(f"t{i}") for i, t in enumerate(ties)],
        ).alias("_order"),
        F.monotonically_increasing_id().alias("_unique"),
    ).withColumn("_arc", arc("_place"))
    order = ["_arc", "_order", "_unique"]
    ranked = pin(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "_row",
            "_arc",
            F.spark_partition_id().alias("_task"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_at"),
        )
    )
    counts = (
        ranked.groupBy("_task", "_arc")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
        .orderBy("_arc", "_task")
        .collect()
    )
    loads: dict[int, int] = {}
    pieces = []
    for r in counts:
        before = loads.get(r["_arc"], 0)
        pieces.append((r["_task"], r["_arc"], before, before + r["n"], r["first"] - before))
        loads[r["_arc"]] = before + r["n"]
    runs: dict[int, list[tuple]] = {}
    for run in place(loads, owners, limits(sum(loads.values()), shards, slack)):
        runs.setdefault(run[0], []).append(run)
    dealt = [
        (task, arc_, max(start, a) + shift, min(end, b) + shift, shard, slot - a - shift)
        for task, arc_, start, end, shift in pieces
        for _, a, b, shard, slot in runs[arc_]
        if max(start, a) < min(end, b)
    ]
    # A row for each arc and task border, and for each run: no more than arcs, tasks and shards.
    deal = spark.createDataFrame(
        dealt, "_task int, _arc int, _from long, _to long, shard int, _slot long"
    )
    at = F.col("_at")
    return (
        ranked.join(F.broadcast(deal), ["_task", "_arc"])
        .where((at >= F.col("_from")) & (at < F.col("_to")))
        .select(
            *unpack(names),
            "shard",
            (at + F.col("_slot")).alias("slot"),
        )
    )
