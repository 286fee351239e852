import hashlib
import random
import zlib

import pytest

from metricloom.llm import merkle, registry

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, `a.b` int, hash int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(values):
    parts = []
    for v in values:
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*parts)


def tree(level):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def way(levels, at, folded):
    passed = []
    for level in levels[:-1]:
        begin = at // 3 * 3
        run = level[begin : begin + 3]
        passed += [x for i, x in enumerate(run) if i != at - begin]
        folded = h(*[folded if i == at - begin else x for i, x in enumerate(run)])
        at //= 3
    return passed, folded


def by_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, entry(r)))
    trees = [tree([entry(r) for r in groups[n]]) for n in names]
    top = tree([t[-1][0] for t in trees])
    found = []
    for g, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            start = entry((*r[:4], r[4].replace("\n", ""))) if hit else entry(r)
            a, folded = way(trees[g], at, start)
            b, folded = way(top, g, folded)
            root = top[-1][0]
            found.append(
                (str(r[0]), entry(r), trees[g][-1][0], root, h(*a, *b), folded, folded == root)
            )
    return sorted(found)


def assert_as_by_force(spark, tmp_path, rows):
    folder = str(tmp_path / f"t{len(rows)}")
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    docs.repartition(6).write.parquet(f"{folder}/documents.parquet")
    got = registry.op13_merkle_manifest(spark, folder).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == by_force(rows)


def test_by_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for name, n in (("hot", 700), ("", 1), (None, 4), ("b", 3), ("Ä", 28), ("z", 82), ("\U0001f642", 9), ("ﬀ", 10)):
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "one line", "ü\n\n", "l" * rng.randrange(50)])
            rows.append((len(rows) * 7 % 1000, name, rng.choice([None, "en"]), rng.choice([None, 5]), text))
    rng.shuffle(rows)
    assert_as_by_force(spark, tmp_path, rows)


def test_many_groups_null_ids_and_copies(spark, tmp_path):
    rows = [(i, f"s{i}", "en", i, f"text {i}\n") for i in range(100)]
    rows += [(None, "s1", None, None, None)] * 3 + [(5, "s5", "en", 1, "copy\n")] * 60
    rows += [(-4, "s5", "de", 1, "x\ny" * 100_000)]
    assert_as_by_force(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[(3, None, None, None, "a\nb")], [(i, "x", "l", 1, "t\n") for i in range(2)]])
def test_lone_leaf_and_one_group(spark, tmp_path, rows):
    assert_as_by_force(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert registry.op13_merkle_manifest(spark, folder).count() == 0


def test_row_limit_of_the_session_comes_back(spark):
    docs = spark.createDataFrame([(i, "a", None, 1, "t", "x", 1, 2) for i in range(5)], SCHEMA)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = merkle.build(docs, COLUMNS)
    assert merkle.climb(spark, found).where("folded <> '%s'" % found.root).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_the_climb_carries_node_rows_not_leaves(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'s' AS source", "string(id) AS text").repartition(4)
    manifest = merkle.build(docs, ["doc_id", "source", "text"])
    carried, pin = [], merkle.pin
    monkeypatch.setattr(merkle, "pin", lambda df: carried.append(pin(df)) or carried[-1])
    got = merkle.climb(spark, manifest)
    assert got.where(f"folded = '{manifest.root}'").count() == 5000
    assert [c.count() for c in carried] == [manifest.nodes.count()] and carried[0].count() < 20
