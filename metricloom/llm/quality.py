"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import pack, unpack

# Most labelled documents of either class that the fit reads, and preference pairs a document.
SAMPLE = 3000
PAIRS = 8
PENALTY = 1e-3
CUT = 0.3

_SYMBOLS = np.zeros(256)
_SYMBOLS[list(b"#$%&*|~^<>{}[]\\=@_/+`")] = 1
_STOPS = np.zeros(256)
_STOPS[list(b"!?")] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LOWER = np.zeros(256)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_CLASSES = np.stack([_SYMBOLS, _STOPS, _UPPER, _LOWER, _DIGIT], axis=1)
_ENDS_ODD = re.compile(r"[^\w\s.,;:]$")
FEATURES = 17


def features(text: str | None) -> list[float]:
    """What a text looks like, in shares and logarithms; no language, no vocabulary."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    symbols, stops, upper, lower, digits = np.bincount(data, minlength=256) @ _CLASSES
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * FEATURES
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(str.__eq__, words, words[1:]))
    odd = sum(c for w, c in counts.items() if _ENDS_ODD.search(w))
    bare = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
    shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ends = sum(c for w, c in counts.items() if w[-1] == ".")
    lines = text.split("\n")
    letters = max(1.0, upper + lower)
    return [
        np.log1p(n),
        symbols / chars,
        stops / chars,
        upper / letters,
        digits / chars,
        chars / n / 10,
        len(counts) / n,
        np.log1p(len(counts)) / np.log1p(n),
        pairs / max(1, n - 1),
        same / max(1, n - 1),
        counts.most_common(1)[0][1] / n,
        odd / n,
        bare / n,
        shout / n,
        ends / n,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, lines))),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features and their squares, and the cut of the raw scores."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` exactly where the raw score meets the quantile cut."""
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + shift, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY) -> Ranking:
    """Bradley-Terry: P(a over b) = sigmoid(w (f(a) - f(b))), fitted by Newton's method.

    Every document of either class meets ``pairs`` of the other. The cut is a quantile of
    the sample's scores: the one that separates the classes best, each class weighing the
    same, in the middle of the gap found. One class alone, or none, gives weights of zero and
    a score of ``CUT`` or more for every text.
    """
    if len(x) == 0:
        x = np.zeros((1, FEATURES))
        y = np.zeros(1)
    spread = x.std(axis=0)
    model = Ranking(tuple(x.mean(axis=0)), tuple(np.where(spread > 1e-9, spread, 1.0)), (), 0.0)
    f = model.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(f.shape[1])
    if not len(good) or not len(bad):
        return Ranking(model.mean, model.scale, tuple(w), -1.0)
    rng = np.random.default_rng(7)
    better = np.concatenate([np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)])
    worse = np.concatenate([rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
    d = f[better] - f[worse]
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = d.T @ p / len(d) - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = f @ w
    levels = np.unique(np.quantile(raw, np.linspace(0, 1, 401), method="lower"))
    keeps = (raw[good, None] >= levels).mean(axis=0) + (raw[bad, None] < levels).mean(axis=0)
    cut = levels[np.argmax(keeps)]
    below = raw[raw < cut]
    cut = (cut + below.max()) / 2 if len(below) else cut
    return Ranking(model.mean, model.scale, tuple(w), float(cut))


def held_out(id_column: Column) -> Column:
    """Documents that take no part in the fit: one in five, by their id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> Ranking:
    """Fit on at most ``sample`` labelled documents of each class outside ``held_out``.

    The sample goes by a hash of the id. Several labels of one id count as their majority,
    an id with a tie, a null id or a null label has none. Of several rows of one id the one with
    the least features counts.
    """
    key = F.col(f"`{id_column}`").cast("long")
    label = F.col(f"`{label_column}`")
    votes = (
        labels.select(key.alias("id"), label.alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id")
        .agg(F.avg("y").alias("y"))
        .where("y <> 0.5")
        .where(~held_out(F.col("id")))
        .select("id", (F.col("y") > 0.5).cast("int").alias("y"), F.xxhash64("id").alias("h"))
    )
    chosen = None
    for y in (0, 1):
        part = votes.where(F.col("y") == y).orderBy("h", "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample ids, whatever the tables' size.
    rows = docs.select(key.alias("id"), F.col(f"`{text_column}`").alias("text")).join(
        F.broadcast(chosen), "id"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "f": found})

    # One row an id, so the bound holds whatever rows repeat.
    got = (
        rows.mapInPandas(read, "id long, y int, f array<double>")
        .groupBy("id", "y")
        .agg(F.min("f").alias("f"))
        .orderBy("y", "id")
        .collect()
    )
    x = np.array([r["f"] for r in got], dtype=float).reshape(-1, FEATURES)
    return fit(x, np.array([r["y"] for r in got]))


def score_documents(
    docs: DataFrame, model: Ranking, text_column: str = "text"
) -> DataFrame:
    """The input with ``score`` (0 to 1) and ``keep`` (the score reaches the cut).

    Every text is read whole; a null or empty text has features of zero. Input columns named
    ``score`` or ``keep`` are replaced. No shuffle.
    """

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([features(t) for t in s], dtype=float).reshape(-1, FEATURES)
            yield pd.Series(model.score(x), dtype="float64")

    row, names = pack(docs, ["score", "keep"])
    return docs.select(row.alias("_row"), rate(f"`{text_column}`").alias("score")).select(
        *unpack(names), "score", (F.col("score") >= CUT).alias("keep")
    )
