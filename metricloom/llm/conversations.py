"""Repair of the structure of conversations at least cost, by tables of symbol blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import BLANKS, digest
from metricloom.operators.skew import attach
from metricloom.session import pin

#: Rows looked up at a time.
BLOCK = 4
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# A row's code: four times its role (system, user, assistant, other) and its fault.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
# States: nothing yet, after a system row, after a user row, after an assistant row. All but
# the second and third may end a conversation.
_END = (0, 6, 3, 0)
_AFTER = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: The state behind an inserted or re-roled row, and the role that it has.
_NEXT = (2, 2, 3, 2)
_ROLES = ("user", "user", "assistant", "user")
_SYMBOLS = 9


class Blocks:
    """Least costs from each state to the end, looked up block by block.

    A cost vector has the least cost of what is left for each state. Less its least entry
    it is one of few, so vectors have numbers, and the way of a vector over every block of
    ``BLOCK`` symbols, backwards, is a table: the next vector's number and the cost taken
    off. A symbol is a row that has to go (0), or 1 + 2 * role + truncated.
    """

    def __init__(self, size: int = BLOCK):
        self.size = size
        self.vectors: list[tuple[int, ...]] = [_END]
        known = {_END: 0}
        following, cost = [], []
        for vector in self.vectors:  # grows while new vectors are met
            row, off = [], []
            for symbol in range(_SYMBOLS):
                new = self._before(vector, symbol)
                least = min(new)
                new = tuple(x - least for x in new)
                if new not in known:
                    known[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append(known[new])
                off.append(least)
            following.append(row)
            cost.append(off)
        self.one, self.one_cost = following, cost
        one, one_cost = np.array(following), np.array(cost)
        table, costs = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), dtype=int)
        for _ in range(size):  # one symbol more on the left, as the leading digit
            costs = np.concatenate([costs + one_cost[table, x] for x in range(_SYMBOLS)], axis=1)
            table = np.concatenate([one[table, x] for x in range(_SYMBOLS)], axis=1)
        self.table, self.costs = table.tolist(), costs.tolist()
        self._digits = _SYMBOLS ** np.arange(size)[::-1]
        self._ways = lru_cache(maxsize=1 << 18)(self._way)

    @staticmethod
    def _before(after: tuple[int, ...], symbol: int) -> list[int]:
        """Least costs before a row, from those after it."""
        cost = [DELETE + x for x in after]
        if symbol:
            role, cut = divmod(symbol - 1, 2)
            for q in range(4):
                to = _AFTER.get((q, role))
                if to is not None:
                    cost[q] = min(cost[q], KEEP + CUT * cut + after[to])
                cost[q] = min(cost[q], REROLE + CUT * cut + after[_NEXT[q]])
        # Inserted rows lead from user to assistant and back, and there from the first two.
        cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
        for q in (0, 1):
            cost[q] = min(cost[q], INSERT + cost[2])
        return cost

    def _trace(self, symbols: list[int], end: int, state: int) -> tuple[str, int]:
        """The least letters of the cheapest edits from ``state``, where the vector behind the
        symbols is ``end``, and the state they lead to. The block is expanded backwards."""
        ids = [end]
        for symbol in reversed(symbols):
            ids.append(self.one[ids[-1]][symbol])
        letters = []
        for symbol, here, behind in zip(symbols, ids[:0:-1], ids[-2::-1], strict=True):
            off = self.one_cost[behind][symbol]
            now, after = self.vectors[here], self.vectors[behind]
            role, cut = divmod(symbol - 1, 2)
            while True:
                least, to = now[state] + off, _NEXT[state]
                if DELETE + after[state] == least:
                    letters.append("D")
                elif INSERT + now[to] + off == least:
                    letters.append("I")
                    state = to
                    continue
                else:
                    kept = _AFTER.get((state, role))
                    if kept is not None and KEEP + CUT * cut + after[kept] == least:
                        letters.append("K")
                        state = kept
                    else:
                        letters.append("R")
                        state = to
                break
        return "".join(letters), state

    def _way(self, block: int, end: int, state: int) -> tuple[str, int]:
        symbols = [block // int(d) % _SYMBOLS for d in self._digits]
        return self._trace(symbols, end, state)

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost and, of the cheapest edits, the letters that come first in ASCII."""
        whole = len(symbols) // self.size * self.size
        blocks = (symbols[:whole].reshape(-1, self.size).astype(np.int64) @ self._digits).tolist()
        rest = symbols[whole:].tolist()
        now = cost = 0
        for symbol in reversed(rest):
            cost += self.one_cost[now][symbol]
            now = self.one[now][symbol]
        ends = [0] * len(blocks)
        for k in range(len(blocks) - 1, -1, -1):
            ends[k] = now
            cost += self.costs[now][blocks[k]]
            now = self.table[now][blocks[k]]
        cost += self.vectors[now][0]
        letters, state = [], 0
        for block, end in zip(blocks, ends, strict=True):
            some, state = self._ways(block, end, state)
            letters.append(some)
        some, state = self._trace(rest, 0, state)
        return cost, "".join(letters) + some + "I" * (_END[state] // INSERT)


@lru_cache(maxsize=1)
def blocks() -> Blocks:
    return Blocks()


def symbols_of(codes: np.ndarray) -> np.ndarray:
    role, fault = codes >> 2, codes & 3
    return np.where(fault >= BLANK, 0, 1 + 2 * role + fault).astype(np.uint8)


def illegal_pairs(codes: np.ndarray) -> int:
    """Neighbours whose roles are not system-user, user-assistant or assistant-user."""
    role = (codes >> 2).astype(int)
    return int((~np.isin(role[:-1] * 4 + role[1:], [1, 6, 9])).sum())


@dataclass
class Repair:
    """``report`` has a row for each conversation. ``rows`` are the repaired ones: those of a
    conversation lie together and in order, within one partition."""

    report: DataFrame
    rows: DataFrame


def _codes(role: Column, text: Column) -> tuple[Column, Column]:
    first = F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    trimmed = F.rtrim(text, F.lit(BLANKS))
    ends = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    return kind * 4, F.when(trimmed == "", BLANK).when(ends, FINE).otherwise(TRUNCATED)


def _chunks(sorted_rows: DataFrame, conv: T.StructField) -> DataFrame:
    """(conv, part, codes, low, high, turns) of each conversation's rows in a partition."""

    schema = T.StructType(
        [
            conv,
            T.StructField("part", T.IntegerType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("low", T.LongType()),
            T.StructField("high", T.LongType()),
            T.StructField("turns", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        for batch in batches:
            closed = []
            for own, turn, part, first, more, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_[0] != own:
                    if open_ is not None:
                        closed.append(open_)
                    open_ = [own, part, bytearray(), None, None, 0]
                if not n:
                    continue
                open_[2] += bytes([first]) + bytes([more]) * (n - 1)
                if turn is not None:
                    open_[5] += turn != open_[4]
                    open_[3] = turn if open_[3] is None else open_[3]
                    open_[4] = turn
            if closed:
                yield record(closed)
        if open_ is not None:
            yield record([open_])

    def record(closed: list[list]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*closed, strict=True)]
        columns[2] = list(map(bytes, columns[2]))
        kinds = [None, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        kinds[0] = kind
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(conv.dataType)
    return sorted_rows.mapInArrow(run, schema)


_FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType())]
)


@F.pandas_udf(_FOUND)
def _solved(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    table = blocks()
    for series in chunks:
        found = []
        for parts in series:
            codes = np.frombuffer(b"".join(bytes(p["codes"]) for p in parts), dtype=np.uint8)
            low = high = None
            turns = 0
            for p in parts:
                if p["low"] is None:
                    continue
                turns += p["turns"] - (p["low"] == high)
                low, high = p["low"] if low is None else low, p["high"]
            gaps = 0 if low is None else int(high) - int(low) + 1 - int(turns)
            faults = np.bincount(codes & 3, minlength=4).tolist()
            cost, audit = table.solve(symbols_of(codes))
            found.append(
                (gaps if gaps < 2**63 else None, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED],
                 illegal_pairs(codes), cost, audit)
            )
        yield pd.DataFrame(found, columns=_FOUND.names)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None,
) -> Repair:
    """Find the faults of conversations and repair them with the cheapest edits.

    Rows of a conversation are taken by turn, null first; rows of one turn by role and then
    by a digest of role and text, so that the result depends on the rows alone. A null role
    or text is one space. A row's first fault counts: blank, duplicate (an earlier row has
    its role and text) or truncated (it does not end in ``.``, ``!`` or ``?``). A repaired
    conversation is empty or has one system row at most, then user and assistant rows in
    turn. Rows are kept, re-roled (3), deleted (4; blank and duplicate rows have to be) or
    inserted with an empty text (3); a truncated row that stays costs 3 more. Of the cheapest
    edits those with the least letters (D, I, K, R) in ASCII are taken.

    ``report``: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit (the letters).
    ``gaps`` is null where it exceeds a long. ``rows``: ``conv``, at, edit, role, text. Rows
    without ``present`` (a condition) take no part but their conversation is reported; a
    null id is a conversation. Other columns of the input are not read.

    Only codes and digests are sorted; equal rows count before they move, and one
    conversation spreads over many tasks, which turn it into a byte a row. These bytes and
    the audit, one cell by its nature, are all that meets in a task. Texts move once, to be
    streamed in order, which one conversation's rows have to be.
    """
    own = F.col(f"`{conv}`")
    given = rows.select(
        own.alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    )
    d0, d1 = digest(F.col("role"), F.col("text"))
    given = given.withColumn("d0", d0).withColumn("d1", d1)
    kind, fault = _codes(F.col("role"), F.col("text"))
    keys = ["conv", "turn", "role", "d0", "d1"]
    counted = pin(
        given.withColumn("kind", kind)
        .withColumn("fault", fault)
        .groupBy(*keys, "kind", "fault")
        .agg(F.count_if("present").alias("n"))
        .withColumn("key", F.to_json(F.struct("conv", "d0", "d1")))
    )
    placed = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeats = pin(
        counted.where("n > 0")
        .groupBy("key")
        .agg(F.min(placed).alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    known = attach(counted, repeats, "key", ["first"], "size")
    blank = F.col("fault") == BLANK
    later = F.col("first").isNotNull() & (F.col("first") != placed)
    order = [F.col(c).asc_nulls_first() for c in keys]
    ranged = (
        known.select(
            *keys,
            (F.col("kind") + F.when(blank | ~later, F.col("fault")).otherwise(DUPLICATE)).alias("code"),
            (F.col("kind") + F.when(blank, BLANK).otherwise(DUPLICATE)).alias("again"),
            "n",
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", F.spark_partition_id().alias("part"), "code", "again", "n")
    )
    chunks = _chunks(ranged, ranged.schema["conv"])
    report = pin(
        chunks.groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("part", "codes", "low", "high", "turns"))).alias("parts"))
        .select("conv", _solved("parts").alias("r"))
        .select("conv", "r.*")
    )
    streamed = (
        given.where("present")
        .select(*keys, "text", F.lit(None).cast("string").alias("audit"))
        .unionByName(report.select("conv", "audit"), allowMissingColumns=True)
        .repartition("conv")
        .sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").asc_nulls_last(), *order[1:])
        .select("conv", "audit", "role", "text")
    )
    repaired = streamed.mapInArrow(
        _edited,
        T.StructType(
            [
                streamed.schema["conv"],
                T.StructField("at", T.LongType()),
                T.StructField("edit", T.StringType()),
                T.StructField("role", T.StringType()),
                T.StructField("text", T.StringType()),
            ]
        ),
    )
    return Repair(report.withColumnRenamed("conv", conv), repaired.withColumnRenamed("conv", conv))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation comes first, then its rows."""
    own, audit, step, state, at = None, "", 0, 0, 0

    for batch in batches:
        found: list[tuple] = []

        def inserted(found=found) -> None:
            nonlocal step, state, at
            while step < len(audit) and audit[step] == "I":
                found.append((own, at, "I", _ROLES[state], ""))
                state, step, at = _NEXT[state], step + 1, at + 1

        for conv, begun, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun is not None:
                inserted()
                own, audit, step, state, at = conv, begun, 0, 0, 0
                continue
            inserted()
            edit = audit[step]
            step += 1
            if edit == "D":
                continue
            if edit == "R":
                role, state = _ROLES[state], _NEXT[state]
            else:
                state = _AFTER[state, {"s": 0, "u": 1, "a": 2}[role[0]]]
            found.append((own, at, edit, role, text))
            at += 1
        if found:
            yield _records(found, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    found = []
    while step < len(audit):
        found.append((own, at, "I", _ROLES[state], ""))
        state, step, at = _NEXT[state], step + 1, at + 1
    if found:
        yield _records(found, kind)


def _records(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["conv", "at", "edit", "role", "text"],
    )


def line_hashes(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256) over the lines ``role:text`` of each conversation, joined by line ends.

    The rows have to lie as ``repair`` gives them: together and in order in one partition.
    They are read as a stream, without a shuffle.
    """
    source = repaired.select(F.col(f"`{conv}`").alias("conv"), F.concat("role", F.lit(":"), "text").alias("line"))
    schema = T.StructType([source.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hashed = kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv_, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = line.encode("utf-8", "surrogatepass")
                if hashed is None or conv_ != own:
                    if hashed is not None:
                        done.append((own, hashed.hexdigest()))
                    own, hashed = conv_, hashlib.sha256(line)
                else:
                    hashed.update(b"\n" + line)
            if done:
                yield record(done, kind)
        if hashed is not None:
            yield record([(own, hashed.hexdigest())], kind)

    def record(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        ids, hashes = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes)], names=["conv", "sha256"])

    return source.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversation rows with faults dealt by a hash of ``conv_id`` and ``turn``, and the
    condition of those that are still there. Nulls become one space but for the two ids.

    Of twenty hashes one drops the row, one empties its text, one takes out its ``.!?``, one
    repeats the row and one makes its role user.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    copies = F.when(case == 0, F.array(F.lit(0))).when(case == 3, F.array(F.lit(1), F.lit(2)))
    hit = rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies.otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return hit, F.col("copy") > 0
