import json
import random

from metricloom.operators import decision
from metricloom.plans import queries

PAIRS = [("orders", "customer"), ("lineitem", "orders"), ("a", "b")]


def metric(tables, sql, gran="monthly"):
    return {
        "name": "m", "description": "d", "sql": sql, "time_range": {"start": "2024", "end": "2024"}, "unit": "count",
        "granularity": gran, "confidence": "high", "agent_notes": "n", "tables_used": tables,
    }


def joined(a, b):
    return metric([a], f"SELECT 1 FROM {a} JOIN {b} ON true")


def by_hand(docs, pairs, required, min_metrics, cap):
    """One run, attempt after attempt, with the counts that grow from one to the next."""
    counts, waived, out = {}, set(), []
    for doc in docs:
        have = doc["measurable_metrics"]
        named = [set(m["sql"].lower().replace(" on true", "").split(" from ")[1].split(" join ")) for m in have]
        rules, before = [], sorted("-".join(p) for p in pairs if frozenset(p) in waived)
        missing = [p for p in pairs if frozenset(p) not in waived and not any(set(p) <= n for n in named)]
        if any(set(m["tables_used"]) - n for m, n in zip(have, named, strict=True)):
            rules.append("ghost_tables")
        for p in missing:
            counts[frozenset(p)] = counts.get(frozenset(p), 0) + 1
            if counts[frozenset(p)] >= cap:
                waived.add(frozenset(p))
        if missing:
            rules.append("foreign_keys")
        used = {t for m in have for t in m["tables_used"]}
        if not rules and set(required) - used:
            rules.append("required_tables")
        if not rules and len(have) < min_metrics:
            rules.append("too_few_metrics")
        if not rules and any(m["granularity"] != "monthly" for m in have):
            rules.append("item_rules")
        out.append(("rejected" if rules else "accepted", rules, before))
        if not rules:
            break
    return out + [("closed", None, None)] * (len(docs) - len(out))


def test_runs_by_hand(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for run in range(40):
        docs = []
        for _ in range(rng.randrange(1, 9)):
            have = [joined(*rng.choice([*PAIRS, ("orders", "part")])) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.2:
                have[0]["tables_used"] = ["orders", "ghost"]
            if rng.random() < 0.3:
                have[-1]["granularity"] = "hourly"
            docs.append({"tables": [{"name": "t"}], "measurable_metrics": have, "queryable_facts": [], "description": "d", "overview": "o"})
        for i, doc in enumerate(docs):
            rows.append((1000 * run + i, f"run {run}", 10 * i, 50, json.dumps(doc)))
        want[f"run {run}"] = by_hand(docs, PAIRS, ["orders"], 2, 2)
    attempts = spark.createDataFrame(rows, "submission_id long, run string, attempt long, iteration long, data string")
    keys = spark.createDataFrame(PAIRS, "from_table string, to_table string")
    required = spark.createDataFrame([("orders",)], "table_name string")
    got = decision.decide(attempts.repartition(4), keys, None, required, min_iterations=3, min_metrics=2).collect()
    assert len(got) == len(rows)
    for r in got:
        status, rules, before = want[r["run"]][r["attempt"] // 10]
        assert r["status"] == status, r
        if status != "closed":
            assert [x["rule"] for x in r["reasons"]] == rules and r["waived"] == before, r


def test_order_and_exclusions_of_reasons(spark):
    good = [joined("orders", "customer")]
    base = {"measurable_metrics": good, "queryable_facts": [], "description": "d", "overview": "o", "tables": [{"name": "t"}]}
    docs = [
        {**base, "tables": "x"}, {**base, "tables": ["t"], "_compressed": True}, base,
        {k: v for k, v in base.items() if k not in ("overview", "description")}, {**base, "measurable_metrics": []},
        {**base, "tables": []}, {**base, "_compressed": False},
    ]
    rows = [(i, str(i), 0, 0, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "x", 0, 9, "no json")]
    attempts = spark.createDataFrame(rows, "submission_id long, run string, attempt long, iteration long, data string")
    keys = spark.createDataFrame([("orders", "customer")], "from_table string, to_table string")
    got = {r["submission_id"]: r for r in decision.decide(attempts, keys, min_iterations=2).collect()}
    rules = {i: [x["rule"] for x in r["reasons"]] for i, r in got.items()}
    assert rules[0] == ["tables_not_list"] and rules[1] == ["bare_tables", "compressed"]
    assert rules[2] == ["too_early"] and rules[6] == ["too_early"] and rules[3] == ["too_early", "keys_absent"]
    assert rules[4] == ["too_early", "empty_lists", "foreign_keys"] and rules[5] == ["too_early", "empty_lists"]
    assert "keys_absent" in rules[99] and got[99]["status"] == "rejected"
    assert {x["rule"]: x["detail"] for x in got[3]["reasons"]}["keys_absent"] == "description,overview"


def test_one_long_run_and_no_run(spark):
    doc = json.dumps({"measurable_metrics": [joined("a", "c")], "queryable_facts": [], "description": "d", "overview": "o", "tables": [{}]})
    attempts = spark.range(300).selectExpr("id AS submission_id", "'r' AS run", "id AS attempt", "9 AS iteration", f"'{doc}' AS data")
    keys = spark.createDataFrame(PAIRS[2:], "from_table string, to_table string")
    status = {r["attempt"]: r["status"] for r in decision.decide(attempts, keys).collect()}
    assert [status[i] for i in range(4)] == ["rejected", "rejected", "accepted", "closed"] and status[299] == "closed"
    assert decision.decide(attempts.limit(0), keys).count() == 0


def test_documents_are_derived_and_read_on_all_cores(spark, tmp_path, monkeypatch):
    parts = spark.range(1, 400).selectExpr("id AS p_partkey").coalesce(1)
    parts.write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(queries.tables, "open_folder", lambda s, folder, names: {"part": s.read.parquet(f"{folder}/part.parquet")})
    seen = []
    decide = decision.decide
    monkeypatch.setattr(decision, "decide", lambda attempts, *a, **kw: seen.append(attempts) or decide(attempts, *a, **kw))
    assert queries.submission_decision(spark, str(tmp_path)).count() == 399
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
