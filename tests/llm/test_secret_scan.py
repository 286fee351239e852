import random
import string

import numpy as np

from metricloom.llm import secret_scan as s
from tests.llm.support import hard_docs, hard_texts

HEX = "0123456789abcdef"
B62 = string.ascii_letters + string.digits


def plain_base(text):
    """The formats by hand: at each place the longest way to go on, then onward behind it."""
    low = "".join(c.lower() if c.isascii() else "\0" for c in text)
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    out, i = [], 0

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            for quote in (True, False):
                k = j
                if quote:
                    if text[k : k + 1] not in ("'", '"'):
                        continue
                    k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "="):
                    continue
                k += 1
                spaces = k
                while text[spaces : spaces + 1] == " ":
                    spaces += 1
                k = spaces + (text[spaces : spaces + 1] in ("'", '"'))
                e = k
                while text[e : e + 1] in value and e < len(text):
                    e += 1
                if e > k:
                    return e, e - k
        return None

    while i < len(text):
        if m := assign(i):
            if m[1] >= 8:
                out.append(("assign", i, m[0]))
            i = m[0]
        else:
            i += 1
    for kind, chars, head, least in (("access", set(string.ascii_uppercase + string.digits), "AKIA", 16), ("hex", set(HEX), "", 32)):
        i = 0
        while i < len(text):
            e = i + len(head)
            while e < len(text) and text[e] in chars:
                e += 1
            if text.startswith(head, i) and e > i + len(head):
                if e - i >= least:
                    out.append((kind, i, e))
                i = e
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], s.BASE_KINDS.index(x[0])))


def test_base_by_force():
    rng = random.Random(6)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ſecret", "x" * 7,
             "abcdef12", "0" * 16, "deadbeef" * 4, "ABCDEFGH", "\U0001f642", "-", "\n", "AKIAAKIA234567890", "pass"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert s.base_spans(text) == plain_base(text), text


def test_battery_levels():
    """Even tokens pass nearly always; words nearly never look random."""
    rng = random.Random(9)
    words = np.array([0.08, 0.015, 0.03, 0.04, 0.127, 0.02, 0.02, 0.06, 0.07, 0.002, 0.008, 0.04, 0.024,
                      0.067, 0.075, 0.019, 0.001, 0.06, 0.063, 0.09, 0.028, 0.01, 0.024, 0.002, 0.02, 0.001])
    for name, alphabet in s.ENCODINGS:
        passed = total = 0
        for _ in range(150):
            token = "".join(rng.choice(alphabet) for _ in range(40))
            kind = s.encoding(token)
            if s.ENCODINGS[kind][0] == name:
                total += 1
                passed += s.random_by_battery(token, kind)
        assert passed >= 0.97 * total
    assert not s.random_by_battery("ab" * 20, 0) and not s.random_by_battery("a" * 40, 0)
    assert s.word_p_value("internationalisation", words) > 0.05
    assert s.word_p_value("somewhatLongCamelCaseName", words) > 0.01
    token = "".join(rng.choice(B62) for _ in range(40))
    assert s.word_p_value(token, words) < 1e-6


def test_limits_are_benjamini_hochberg():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(size=900), 10.0 ** -rng.uniform(6, 12, size=40)])
    counts = {(0, 5): np.bincount([s._bin(x) for x in p], minlength=s.BINS).astype(float)}
    found = sum(s._bin(x) >= s.discovery_limits(counts, 0.01)[0, 5] for x in p)
    order = np.sort(p)
    exact = max(i + 1 for i, x in enumerate(order) if x <= 0.01 * (i + 1) / len(p))
    assert 40 <= found <= exact
    assert s.discovery_limits({(0, 4): np.bincount([0] * 50, minlength=s.BINS).astype(float)}, 0.01) == {}


def test_scan(spark):
    rng = random.Random(2)
    secret = "".join(rng.choice(B62) for _ in range(40))
    words = ["stone", "river", "lights", "walking", "under", "greenhouse", "internationalisation", "tables"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(100, 160)]
    rows[7] = (107, f"here {secret} stands")
    rows[8] = (108, f"Überall password = '{secret}' stands")
    rows += hard_texts()
    docs = hard_docs(spark, rows)
    found = s.scan_secrets(docs)
    assert found.columns == ["doc_id", "lang", "_row", "score", "a.b", "k0", "base", "found"]
    got = found.collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [tuple(x)[1:] for x in by_id[107]["found"]] == [(5, 45)] and by_id[107]["base"] == []
    assert [x["kind"] for x in by_id[108]["base"]] == ["assign"] and by_id[108]["found"] == []
    assert not [r for r in got if r["doc_id"] not in (107, 108) and (r["base"] or r["found"])]
    assert s.scan_secrets(docs.limit(0)).count() == 0


def test_copies_of_a_token_are_one_test(spark):
    rng = random.Random(12)
    words = ["stone", "river", "lights", "walking", "under", "greenhouse", "tables"]
    text = " ".join(words)
    share = np.array([1 + text.count(c) for c in string.ascii_lowercase], dtype=float)
    share /= share.sum()
    p = 1.0
    while not 3e-5 < p < 3e-4:
        secret = "".join(rng.choice(B62) for _ in range(20))
        p = s.word_p_value(secret, share) if s.encoding(secret) == 5 else 1.0
    rows = [(1, f"{text} {secret} {text}"), (2, f"{text} SomewhatLongCamelCaseName1 {text}")]
    few = s.scan_secrets(hard_docs(spark, rows))
    many = s.scan_secrets(hard_docs(spark, rows + rows[1:] * 4000))
    for found in (few, many):
        got = found.where("doc_id = 1").collect()
        assert [tuple(x)[1:] for x in got[0]["found"]] == [(len(text) + 1, len(text) + 21)]
    assert many.where("doc_id = 2 AND size(found) > 0").count() == 0
