"""Indel similarity: twice the longest common subsequence over the total length, in per cent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a column of the table at once as the bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether two strings can be similar enough, by their lengths and then by the edit distance, which insertions and deletions bound."""
    total = F.length(a) + F.length(b)
    return (200.0 * F.least(F.length(a), F.length(b)) >= cutoff * total) & (F.levenshtein(a, b) * 100.0 <= (100.0 - cutoff) * total)
