import hashlib

from metricloom.llm.line_dedup import dedup_lines
from tests.llm.support import hard_docs, hard_texts

BLANKS = " \t\n\x0b\x0c\r"
DOWN = {c: c + 32 for c in range(65, 91)}


def by_force(rows, min_docs=2):
    big = 2**63 - 1
    holders = {}
    key = lambda line: line.strip(BLANKS).translate(DOWN)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(big if i is None else i)
    out = []
    for i, t in rows:
        own, lines = big if i is None else i, (t or "").split("\n")
        shared = lambda line, own=own: len(holders.get(key(line), ())) >= min_docs and min(holders[key(line)]) != own
        kept = [x for x in lines if not shared(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(spark, rows, **options):
    found = dedup_lines(hard_docs(spark, rows), **options)
    assert [c for c in found.columns if c != "text"] == [
        "doc_id", "lang", "_row", "score", "a.b", "k0", "n_lines", "n_dropped",
    ]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()]
    assert sorted(got, key=str) == by_force(rows, options.get("min_docs", 2))


def test_hard_cases(spark):
    check(spark, hard_texts())


def test_shared_lines(spark):
    rows = [
        (3, "Shared Line Number One\nown words of three\nÉCOLE fermée aujourd'hui"),
        (1, "  shared line number one\t\nshort\nshort"),
        (2, "short\nSHARED LINE NUMBER ONE\r\n\nécole fermée aujourd'hui\n"),
        (2, "a repeated row id, shared line number one\nshared line number one"),
        (9, "same twice in here\nsame twice in here"),
        (None, "shared line number one"),
    ]
    check(spark, rows)
    check(spark, rows, min_docs=3)


def test_empty_table(spark):
    assert dedup_lines(hard_docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_long_text_is_linear(spark):
    lines = [f"line number {i} of the long document" for i in range(40_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_dropped"] == 20_000
    own = hashlib.sha256("\n".join(lines[1::2]).encode()).hexdigest()
    assert hashlib.sha256(got[2]["text"].encode()).hexdigest() == own
