import random

from metricloom.llm import decontaminate as d
from tests.llm.support import hard_docs, hard_texts


def plain_score(item, passage):
    """Best local alignment, cell by cell."""
    rows = [[0] * (len(passage) + 1)]
    for w in item:
        row = [0]
        for j, v in enumerate(passage, 1):
            match = rows[-1][j - 1] + (d.MATCH if w == v else d.MISMATCH)
            row.append(max(0, match, rows[-1][j] + d.GAP, row[-1] + d.GAP))
        rows.append(row)
    return max(map(max, rows)) / (d.MATCH * len(item))


def test_alignment_by_force():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        passage = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        score, first, last = d.alignment(item, passage)
        assert score == plain_score(item, passage)
        if score:
            assert plain_score(item, passage[first : last + 1]) == score
    assert d.alignment([], ["a"])[0] == 0 == d.alignment(["a"], [])[0]


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 40)))) for i in range(12)]
    items += [(100, "two Words"), (101, ""), (102, None), (0, items[0][1]), (None, "an item without any number here")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if i % 2:
            copy = d.words_of(items[i % 12][1])
            for _ in range(i % 7):  # edits
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            text[3:3] = copy
        docs.append((i, " ".join(text).title() + "!"))
    docs += [(70, "there are two, words."), (71, "an item without any number here"), (1, docs[1][1])]
    return docs + [(None if i is None else i + 1000, t) for i, t in hard_texts()], items


def test_leaks_by_force(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(hard_docs(spark, docs), bench)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()}
    assert found.count() == len(got)
    want = {}
    for i, t in docs:
        words = d.words_of(t)
        if len(words) > 1000:
            continue
        for j, item in items:
            own = d.words_of(item)
            grams = {tuple(own[x : x + 8]) for x in range(len(own) - 7)}
            long_run = any(tuple(words[x : x + 8]) in grams for x in range(len(words) - 7))
            if own and (s := plain_score(own, words)) >= d.THRESHOLD:
                want[i, j] = max(s, want.get((i, j), (0, 0))[0]), long_run or own == words or s == 1
    assert set(got) <= set(want)
    # All that keep eight words in a row, or short items whole, are found.
    assert {k for k, (_, sure) in want.items() if sure} <= set(got)
    assert all(abs(got[k] - want[k][0]) < 1e-12 for k in got)
    assert sum(k in got for k in want) >= 0.9 * len(want)


def test_leaks_are_dropped(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [x for x in docs if x[0] != 1]
    rows = hard_docs(spark, docs)
    leaked = {r["doc_id"] for r in d.find_leaks(rows, bench).collect()}
    assert None not in leaked and 71 in leaked
    kept = d.drop_leaks(rows, bench)
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    rows = hard_docs(spark, [(1, "some words of an item"), (2, None)])
    assert d.find_leaks(rows, bench).count() == 1
    assert d.find_leaks(rows.limit(0), bench).count() == 0
    assert d.find_leaks(rows, bench.limit(0)).count() == 0
    assert d.drop_leaks(rows, bench.limit(0)).count() == 2


def test_every_seed_of_an_edited_copy_counts(spark):
    """Whole copies make the n-grams that an edited one lost rarer than those it kept."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(17))) for i in range(60)]
    docs, want = [], set()
    for i, text in items:
        docs.append((i, text))
        copy = text.split()
        for at in rng.sample(range(17), 4):
            copy[at] = "other"
        docs.append((1000 + i, "before it " + " ".join(copy) + " after it"))
        run = any("other" not in copy[x : x + d.GRAM] for x in range(17 - d.GRAM + 1))
        want |= {(i, i)} | ({(1000 + i, i)} if run and plain_score(text.split(), copy) >= d.THRESHOLD else set())
    assert len(want) > 90
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(hard_docs(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
