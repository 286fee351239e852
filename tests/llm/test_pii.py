import random
import re

from metricloom.llm import pii
from tests.llm.support import hard_docs, hard_texts

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def spans(rows):
    return [tuple(x) for x in rows]


def test_base_by_force(spark):
    rng = random.Random(4)
    parts = ["a.b", "@", "x@y.org", ".", "-", " ", "+1", "(555)", "123", "4567", "8 9", "256", "10.0.0.1", "..", "_%+",
             "4918187128635271", "4111 1111 1111 1111", "\U0001f642é", "\n", "+", ")", "a@b", ".c", "0001", "٣"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(3000)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: spans(r["base"]) for r in found.collect()}
    for i, t in rows:
        assert got[i] == plain_base(t), t


def test_long_runs_do_not_break(spark):
    rows = [(1, "a@b" + ".c" * 60_000), (2, "1 " * 60_000), (3, "x" * 200_000), (4, "1." * 50_000), (5, "+1" + "(" * 90_000)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: spans(r["base"]) for r in found.collect()}
    assert got[1] == [("email", 0, 120_003)] and got[2] == got[3] == got[5] == []
    assert len(got[4]) == 12_500


def contacts(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        number = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        if i % 4 == 0:
            text = f"please call +1 {number} tomorrow"
        elif i % 4 == 1:
            text = f"order {rng.randrange(10**9, 10**10)} of shelf {rng.randrange(10**7, 10**8)} left"
        else:
            text = "nothing personal stands in here"
        rows.append((i, text))
    return rows


def test_trees_add_nothing_to_clean_texts(spark):
    rows = contacts(240) + hard_texts()
    docs = hard_docs(spark, rows)
    found = pii.find_personal_data(docs)
    assert found.columns == ["doc_id", "lang", "_row", "score", "a.b", "k0", "base", "found"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        base = spans(r["base"])
        for _, start, end in spans(r["found"]):
            assert all(end <= s or start >= e for _, s, e in base)
    assert not [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 2 and r["found"]]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_trees_find_the_format_without_its_sign(spark):
    rows = contacts(400) + [(1000, "please call (308) 555-7782 tomorrow")]
    found = pii.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string"), precision=0.9
    )
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1000]["base"] == []
    assert [x["kind"] for x in got[1000]["found"]] == ["number"]


def test_the_trees_learn_from_every_candidate(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    learned, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: learned.append((self, rows)) or fit(self, rows))
    rows = [(i, f"order {10**9 + i} left") for i in range(9000)] + [(i, f"call +1 (308) 555-{i}") for i in range(9000, 9400)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == len(rows)
    (trees, forms), = learned
    weight = trees.getWeightCol()
    n = {r["label"]: r["n"] for r in forms.groupBy("label").agg({weight: "sum"}).toDF("label", "n").collect()}
    # Half of all candidates: more than any sample of 3,000 a class had.
    assert n[0.0] > 4000 and n[1.0] > 150 and forms.count() < 200
