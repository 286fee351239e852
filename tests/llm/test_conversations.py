import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from metricloom.llm import conversations as c
from metricloom.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, audit string, `a.b` int, conv string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
OTHER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, letters, repaired) by trying every edit; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        tries = []
        if inserts < 3:
            cost, letters, out = best(i, OTHER[state], inserts + 1)
            role = {"u": "user", "a": "assistant"}[OTHER[state]]
            tries.append((cost + 3, "I" + letters, ((role, ""), *out)))
        if i == len(rows):
            if state in ("", "a"):
                tries.append((0, "", ()))
            return min(tries, default=(10**9, "", ()))
        role, text, fault = rows[i]
        cost, letters, out = best(i + 1, state, 0)
        tries.append((cost + 4, "D" + letters, out))
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in AFTER:
                cost, letters, out = best(i + 1, AFTER[state, role[:1]], 0)
                tries.append((cost + more, "K" + letters, ((role, text), *out)))
            new = {"u": "user", "a": "assistant"}[OTHER[state]]
            cost, letters, out = best(i + 1, OTHER[state], 0)
            tries.append((cost + 3 + more, "R" + letters, ((new, text), *out)))
        return min(tries)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in OTHER:
            best(i, state, 0)
    return best(0, "", 0)


def by_force(rows):
    """The contract, read row by row; rows are (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        case = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        if case == 1:
            text = ""
        if case == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if case == 4:
            role = "user"
        kept.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(case, 1))
    found = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, marked = set(), []
        for _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = ""
            if not words:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif words[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
        cost, letters, out = cheapest(tuple(marked))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        found[conv] = (
            gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def assert_as_by_force(spark, tmp_path, rows, parts=5):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    folder = str(tmp_path / f"t{len(rows)}")
    docs.repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    got = registry.op12_conversation_repair(spark, folder).collect()
    want = by_force(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], (r, want[r["conv_id"]])


def test_tables_against_trying_all():
    rng = random.Random(3)
    for size in (1, 2, 4):
        table = c.Blocks(size)
        for _ in range(250):
            n = rng.randrange(10)
            rows = tuple(
                (rng.choice(["system", "user", "assistant", "tool", ""]), str(i), rng.choice(["", "", "truncated", "blank", "duplicate"]))
                for i in range(n)
            )
            kinds = {"s": 0, "u": 1, "a": 2}
            faults = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
            codes = np.array([4 * kinds.get(r[:1], 3) + faults[f] for r, _, f in rows], dtype=np.uint8)
            cost, letters = table.solve(c.symbols_of(codes))
            assert (cost, letters) == cheapest(rows)[:2]


def test_conversations_by_force(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "What now?", "and then", "  ", "", "Ende. ", "a \n", None, "é…", "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "sys", ""]
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample(range(14), rng.randrange(1, 10)):
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(900, None, "system", "Be kind."), (900, 2**62, "user", "Hm?"), (901, None, "user", "No.")]
    assert_as_by_force(spark, tmp_path, rows)


def test_repeated_rows_and_turns(spark, tmp_path):
    rows = [(1, 3, "user", "Same.")] * 40 + [(1, t, "user", "Same.") for t in range(30)]
    rows += [(1, 50 + t, r, f"{t}.") for t in range(40) for r in ("assistant", "user")]
    assert_as_by_force(spark, tmp_path, rows)


def test_one_conversation_over_all_tasks(spark, tmp_path):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{t} is it"])) for t in range(900)]
    rows += [(8, 1, "user", "x" * 200_000), (8, 2, "assistant", "y" * 200_000 + ".")]
    assert_as_by_force(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    assert registry.op12_conversation_repair(spark, folder).count() == 0


def test_rows_of_a_repair(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (1, 3, "assistant", "Yes."), (2, 0, "tool", " ")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = c.repair(docs)
    got = [tuple(r) for r in found.rows.orderBy("conv_id", "at").collect()]
    assert got == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "K", "user", "So?"),
        (1, 3, "K", "assistant", "Yes."),
    ]
    assert {r["conv_id"]: r["audit"] for r in found.report.collect()} == {1: "IKKK", 2: "D"}
    assert found.report.where(F.col("cost") == 3).count() == 1
