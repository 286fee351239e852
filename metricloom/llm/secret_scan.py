"""Secrets in texts: fixed formats, and tokens that randomness tests tell from words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import pack, unpack
from metricloom.session import pin

# The formats of the contract, and the least length each match must have.
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

#: The method's candidates: runs of token characters of at least so many, at most so many at once.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PIECE = 256
LEVEL = 0.01
STRICT = 1e-4
_LONG_HEX = re.compile(r"[0-9a-f]{32}")

# Encodings from the narrowest: a token has the first that holds all its characters.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64_url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_ALPHABETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed formats, by start, then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [
            ("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS
        ]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    # Only texts with such a run at all are cut into runs of hexadecimal digits.
    if _LONG_HEX.search(text):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def encoding(token: str) -> int | None:
    """Number of the narrowest encoding, padding aside."""
    chars = set(token.rstrip("="))
    for i, (_, alphabet, _) in enumerate(_ALPHABETS):
        if chars <= alphabet:
            return i
    return None


def _tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, kind: int) -> tuple[float, float, float]:
    """z scores of a token under "drawn evenly from its alphabet": chi-squared uniformity
    (large: uneven), runs above and below the alphabet's middle, serial correlation."""
    index = _ALPHABETS[kind][2]
    size = len(index)
    x = np.array([index[c] for c in token.rstrip("=")], dtype=float)
    n = len(x)
    if n < 4:
        return 9.0, 0.0, 0.0
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = x >= size / 2
    runs = 1 + int((high[1:] != high[:-1]).sum())
    z_runs = (runs - (1 + (n - 1) / 2)) / math.sqrt((n - 1) / 4)
    # The alphabet's own mean and variance, not the token's: a constant token is uneven too.
    y = (x - (size - 1) / 2) / math.sqrt((size**2 - 1) / 12)
    z_serial = float((y[1:] * y[:-1]).sum()) / math.sqrt(n - 1)
    return z_chi, z_runs, z_serial


def word_p_value(token: str, words: np.ndarray) -> float:
    """P value of a token under "spelled like words".

    Its evenness is compared with what letters drawn with the corpus's frequencies
    (``words``: shares of the letters of words, a to z) give at this length, and its
    switches between letter cases and digits with one in five characters; signs between
    words do not count. Few repeats and many switches are both unlikely for words; the
    longer the token, the more so.
    """
    body = [c for c in token if c.isalnum()]
    n = len(body)
    if n < 8:
        return 1.0
    squares = float((words**2).sum())
    cubes = float((words**3).sum())
    pairs = n * (n - 1) / 2
    lower = "".join(body).lower()
    same = sum(c * (c - 1) // 2 for c in map(lower.count, set(lower)))
    # Equal pairs among n letters: mean, and variance with the pairs that share a letter.
    mean = pairs * squares
    spread = pairs * squares * (1 - squares) + 6 * pairs * (n - 2) / 3 * (cubes - squares**2)
    z = (mean - same) / math.sqrt(max(spread, 1e-9))
    classes = [0 if c.islower() else 1 if c.isupper() else 2 for c in body]
    switches = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    rate = 0.2
    tail = (switches - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate))
    return _tail((z + tail) / math.sqrt(2))


def random_by_battery(token: str, kind: int) -> bool:
    """No test rejects evenness, each at its share of ``STRICT``."""
    z_chi, z_runs, z_serial = battery(token, kind)
    least = STRICT / 3
    # The chi-squared tail by the cube-root transform, which holds for short tokens.
    df = len(_ALPHABETS[kind][2]) - 1
    chi = max(1e-9, z_chi * math.sqrt(2 * df) + df)
    wilson = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return _tail(wilson) >= least and min(2 * _tail(abs(z_runs)), 2 * _tail(abs(z_serial))) >= least


def candidates(text: str, base: list[tuple[str, int, int]], words: np.ndarray) -> list[tuple]:
    """(start, end, encoding, length class, p value) of the tokens that no base span meets."""
    found, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        if at < len(base) and base[at][1] < end:
            continue
        token = m[0]
        kind = encoding(token)
        if kind is None or token.isdigit():
            continue
        # Long runs are judged by their pieces, all of which must look random.
        pieces = [token[i : i + PIECE] for i in range(0, len(token), PIECE)]
        pieces = [p for p in pieces if len(p) >= 16] or [token]
        p = max(word_p_value(x, words) for x in pieces)
        if not all(random_by_battery(x, kind) for x in pieces):
            p = 1.0
        found.append((start, end, kind, min(8, int(math.log2(end - start))), p))
    return found


def letter_shares(docs: DataFrame, text_column: str) -> np.ndarray:
    """Shares of a to z among the letters of all texts, counted per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, dtype=np.int64)
        for b in batches:
            for t in b.iloc[:, 0]:
                if t:
                    raw = np.frombuffer(t.lower().encode("utf-8", "replace"), dtype=np.uint8)
                    total += np.bincount(raw, minlength=256)
        yield pd.DataFrame({"c": np.arange(26), "n": total[97:123]})

    counted = docs.select(F.col(f"`{text_column}`").alias("t")).mapInPandas(count, "c int, n long")
    rows = counted.groupBy("c").agg(F.sum("n").alias("n")).collect()
    n = np.ones(26)
    for r in rows:
        n[r["c"]] += r["n"]
    return n / n.sum()


BINS = 64


def _digest(token: str) -> dict[str, int]:
    """128 bits that stand for a token, as two longs."""
    d = xxhash.xxh3_128_digest(token)
    return {f"d{i}": int.from_bytes(d[8 * i : 8 * i + 8], "big", signed=True) for i in (0, 1)}


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log2(max(p, 1e-30)) * BINS / 100))


def discovery_limits(counts: dict[tuple[int, int], np.ndarray], level: float) -> dict:
    """Benjamini-Hochberg limit of each (encoding, length class): the largest bin of p values
    whose upper edge is within ``level`` x found / tested. Short tokens, whose tests say
    little, so cannot spend what long ones earn."""
    limits = {}
    for key, n in counts.items():
        total = n.sum()
        found = n[::-1].cumsum()[::-1]  # as unlikely as this bin, or more
        for b in range(BINS):
            edge = 2.0 ** (-b * 100 / BINS)
            if found[b] and edge <= level * found[b] / total:
                limits[key] = b
                break
    return limits


def scan_secrets(
    docs: DataFrame, text_column: str = "text", level: float = LEVEL
) -> DataFrame:
    """The input's columns but the text, with ``base`` and ``found``: arrays of
    (kind, start, end), in characters, the end exclusive.

    ``base`` has the fixed formats, leftmost and without overlaps per kind, by start and
    kind. ``found`` has the tokens that pass the randomness battery of their encoding, that
    words would not give, and that the false-discovery control keeps, for which equal tokens
    are one test; their kind is ``random_`` and the encoding. They never overlap a base span.

    Null and empty texts have no spans. Repeated rows come back each, input columns named
    like an output are replaced. Texts are read whole, twice (letter counts, then tokens),
    and never shuffled, digests of tokens are; the driver gets 26 letter counts and a histogram.
    """
    words = letter_shares(docs, text_column)
    row, names = pack(docs, [text_column, "base", "found"])
    span = "array<struct<kind:string,start:int,end:int>>"
    token = "array<struct<start:int,end:int,enc:int,size:int,bin:int,d0:long,d1:long>>"

    @F.pandas_udf(f"struct<base:{span},tokens:{token}>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        bases, tokens = [], []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            tokens.append(
                [
                    {"start": s, "end": e, "enc": k, "size": n, "bin": _bin(p), **_digest(t[s:e])}
                    for s, e, k, n, p in candidates(t, base, words)
                ]
            )
        return pd.DataFrame({"base": bases, "tokens": tokens})

    scanned = pin(docs.select(row.alias("_row"), scan(f"`{text_column}`").alias("_s")))
    counts: dict[tuple[int, int], np.ndarray] = {}
    tallied = (
        # A token is one test however often it occurs.
        scanned.select(F.explode("_s.tokens").alias("t"))
        .select("t.enc", "t.size", "t.bin", "t.d0", "t.d1")
        .distinct()
        .groupBy("enc", "size", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    for r in tallied.collect():  # encodings x length classes x bins
        counts.setdefault((r["enc"], r["size"]), np.zeros(BINS))[r["bin"]] += r["n"]
    limits = discovery_limits(counts, level)
    # Bin limit by encoding and length class; one that no token reaches where there is none.
    flat = [limits.get((k, n), BINS) for k in range(len(ENCODINGS)) for n in range(9)]
    least = F.array(*map(F.lit, flat))
    kinds = F.array(*[F.lit(f"random_{name}") for name, _ in ENCODINGS])
    kept = F.filter("_s.tokens", lambda t: t["bin"] >= least[t["enc"] * 9 + t["size"]])
    return scanned.select(
        *unpack(names),
        F.col("_s.base").alias("base"),
        F.transform(
            kept,
            lambda t: F.struct(
                kinds[t["enc"]].alias("kind"), t["start"].alias("start"), t["end"].alias("end")
            ),
        ).alias("found"),
    )
