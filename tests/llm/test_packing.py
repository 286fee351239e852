import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricloom.llm import packing as p
from metricloom.llm import registry
from tests.llm.support import hard_docs, hard_texts

MODEL = open(public_tokenizers.path(p.TOKENIZER), encoding="utf-8").read()
WORDS, WHOLE = p.Words(MODEL), Tokenizer.from_str(MODEL)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def assert_packed(rows, docs, length):
    """Every id lies in one piece, sequences have no gaps and are no longer than allowed."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    found = sorted(
        (own[0]["doc_tokens"], tuple(i for r in sorted(own, key=lambda r: r["start"]) for i in r["ids"]))
        for own in pieces.values()
    )
    assert found == sorted((len(ids_of(t)), tuple(ids_of(t))) for t in docs)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += len(r["ids"])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"])
        assert at <= length
    return sequences


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sSTré.,!1ΣΑİ\x1c\x85\xa0\0́<|>"), st.characters()), max_size=40))
def test_words_give_the_ids_of_the_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert WORDS.encode(pa.array([text]))[0].tolist() == ids_of(text)[:-1]


def test_plain_words_and_forgetting(monkeypatch):
    letters = "".join(map(chr, [*range(33, 127), *range(0xC0, 0x100)]))
    texts = [" ".join(a + b for b in letters) for a in "aÉß9'.×"]
    assert [x.tolist() for x in WORDS.encode(pa.array(texts))] == [ids_of(t)[:-1] for t in texts]
    monkeypatch.setattr(p, "KNOWN", 60)
    few = p.Words(MODEL)
    for _ in range(3):
        for t in texts:
            assert few.encode(pa.array([t]))[0].tolist() == ids_of(t)[:-1]


def test_special_strings_and_other_tokenizers():
    for text in ("a <|endoftext|>b c", "<|startoftext|>", "x<|endoftext|>"):
        assert WORDS.encode(pa.array([text]))[0].tolist() == ids_of(text)[:-1]
    other = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert p.Words(other).encode(pa.array([" two  words\n"]))[0].tolist() == Tokenizer.from_str(other).encode(
        " two  words\n", add_special_tokens=False
    ).ids


def test_first_fit_by_force():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randrange(1, 11) for _ in range(rng.randrange(40))]
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [10] * (at == len(room))
            room[at] -= s
            want.append(at)
        assert p.first_fit(sizes, 10) == want


def test_group_is_packed_whole_and_tight():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.choice([rng.randrange(1, 2048), 1100, 1500]) for _ in range(rng.randrange(1, 60))]
        packed = p.pack_group(sizes, 2048)
        got = {}
        for own in packed:
            assert 0 < sum(n for _, _, n in own) <= 2048
            for item, a, n in own:
                got.setdefault(item, []).append((a, n))
        for item, parts in got.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at and n > 0
                at += n
            assert at == sizes[item]
        assert len(got) == len(sizes)
        used = sorted(sum(n for _, _, n in own) for own in packed)
        assert len(packed) * 2048 - sum(used) < 2048 + used[0]


def test_hard_cases(spark):
    texts = [t for t in hard_texts() if t[0] != 6]
    texts += [(100 + i, " ".join(f"w{j} x{i}" for j in range(40 * i))) for i in range(12)]
    texts += [(5, "One copy of many.")] * 50
    docs = hard_docs(spark, texts).withColumn("doc", F.monotonically_increasing_id())
    found = p.pack_documents(docs, length=64, group=16)
    assert found.columns == [
        "doc_id", "lang", "_row", "score", "a.b", "k0", "doc", "start", "doc_tokens", "sequence_id", "offset", "ids"
    ]
    rows = found.collect()
    assert_packed(rows, [t for _, t in texts], 64)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    assert p.pack_documents(docs.limit(0)).count() == 0


def test_reruns_agree(spark):
    texts = [(i, f"some text of {i} " * (i % 9 + 1)) for i in range(80)]
    docs = hard_docs(spark, texts)
    a, b = (sorted(map(str, p.pack_documents(docs, length=32, group=20).collect())) for _ in range(2))
    assert a == b


def test_long_text_and_query(spark, tmp_path):
    texts = [(1, "word " * 60_000), (2, None), (None, "x" * 30_000), (3, "Été 42's")]
    folder = str(tmp_path)
    hard_docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    rows = registry.op11_packing(spark, folder).collect()
    for r in rows:
        text = dict(texts)[r["doc_id"]]
        ids = ids_of(text)
        part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids)
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) for _, t in texts)
