"""Name similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series, needed: pd.Series) -> pd.Series:
    """Share of matched characters, called only for candidate pairs; 0 where a cheap
    upper bound already lies below ``needed``."""
    ratios = []
    matcher = SequenceMatcher(None)
    for a, b, least in zip(left, right, needed):
        matcher.set_seqs(a, b)
        ratios.append(matcher.ratio() if matcher.quick_ratio() >= least else 0.0)
    return pd.Series(ratios, dtype="float64")


# Marked so that a filter on the score does not run it a second time.
sequence_ratio = _sequence_ratio.asNondeterministic()


def words(name: Column) -> Column:
    """Distinct words; an underscore separates words as a space does."""
    parts = F.split(F.regexp_replace(name, "_", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words of two word lists."""
    together = F.size(F.array_union(left, right))
    return F.size(F.array_intersect(left, right)) / F.greatest(together, F.lit(1))
