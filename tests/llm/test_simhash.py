import random

import numpy as np
import pytest
import xxhash

from metricloom.llm import simhash
from metricloom.llm.components import components
from tests.llm.support import hard_docs, hard_texts

DOWN = {c: c + 32 for c in range(65, 91)}


def plain_print(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(DOWN)).split(" ") if w]
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(prints, radius):
    """Least reachable key of each fingerprint, all pairs compared."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = list(prints)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_fingerprints(spark):
    for _, text in hard_texts()[:8] + [(0, "One two"), (0, "ÀB c d\x1ce F")]:
        assert simhash.fingerprint(text) == plain_print(text)


def near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_connect_what_all_pairs_connect(spark, tile):
    rng = random.Random(5)
    prints = {0, 1, 2**64 - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        prints |= {near(rng, base, rng.randrange(0, 5)) for _ in range(12)}
    base = rng.getrandbits(64)  # one large ball
    prints |= {near(rng, base, rng.randrange(0, 4)) for _ in range(150)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 3, tile)
    rows = components(found).collect()
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in rows}
    want = plain_groups(prints, 3)
    for a in prints:
        for b in prints:
            assert (root.get(a, a) == root.get(b, b)) == (want[a] == want[b])


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(99)]
    edges += [(names[100], names[i]) for i in range(101, 200)]
    edges += [(names[200], names[200]), (names[201], names[202]), (names[202], names[201]), (None, 5)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 100, 100]
    assert all(root in nodes for root, nodes in groups.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def make_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((i * 10 + 5, " ".join(base)))
        rows.append((i * 10 + 2, " ".join(base).upper()))
        base[rng.randrange(300)] = "changed"
        rows.append((i * 10 + 9, "  ".join(base)))
    return rows + hard_texts()


def test_near_duplicates_by_force(spark):
    rows = make_texts()
    prints = {plain_print(t) for _, t in rows}
    root = plain_groups(prints, 3)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[plain_print(t)]
            least[r] = min(i, least.get(r, i))
    want = [(i, plain_print(t), least.get(root[plain_print(t)])) for i, t in rows]
    found = simhash.near_duplicates(hard_docs(spark, rows)).collect()
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    groups = {}
    for i, p, c in want:
        groups.setdefault(c if c is not None else ("none", root[p]), []).append(i)
    kept = simhash.keep_one(hard_docs(spark, rows))
    assert kept.columns == hard_docs(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(c) if not isinstance(c, tuple) else "None" for c in groups)


def test_empty_table(spark):
    empty = hard_docs(spark, [(1, "x")]).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_few_links_are_kept_in_few_files(spark, monkeypatch):
    from metricloom.llm import components as c

    kept = []

    real = c.pin
    monkeypatch.setattr(c, "pin", lambda df: kept.append(real(df)) or kept[-1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 50], "a long, b long")
        found = {r["node"]: r["root"] for r in c.components(edges).collect()}
    finally:
        spark.conf.set(key, "true")
    assert set(found) == set(range(1, 301)) and len(set(found.values())) == 6
    assert all((n - 1) // 50 == (r - 1) // 50 for n, r in found.items())
    assert max(df.rdd.getNumPartitions() for df in kept[1:]) == 1
