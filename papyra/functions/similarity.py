"""Indel and weighted similarity, 0..100, over pairs of strings, and the singular/plural rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a character of ``a`` (Hyyrö 2004)."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & place.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def partial(a: str, b: str) -> float:
    """The best indel ratio of the shorter string against parts of the longer one of its length or less, at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    parts = [b[i:i + n] for i in range(len(b) - n + 1)] + [b[:i] for i in range(1, n)] + [b[-i:] for i in range(1, n)]
    return max(indel(a, p) for p in parts)


def token_set(a: str, b: str, score=indel) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only, other = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only or not other):
        return 100.0
    s, t = f"{both} {only}".strip(), f"{both} {other}".strip()
    return max(score(s, t), score(both, s) if both else 0.0, score(both, t) if both else 0.0)


def wratio(a: str, b: str) -> float:
    """The public definition: plain and token ratios at like lengths, partial ones, scaled down, beyond 1.5 times."""
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    order = lambda s: " ".join(sorted(s.split()))
    best = indel(a, b)
    if long < 1.5:
        return max(best, 0.95 * max(indel(order(a), order(b)), token_set(a, b)))
    scale = 0.9 if long <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    if x & y:
        return max(best, scale * partial(a, b), scale * 0.95 * 100.0)
    # words that repeat count once in one of the two
    words = max(partial(order(a), order(b)), partial(order(" ".join(x)), order(" ".join(y))))
    return max(best, scale * partial(a, b), scale * 0.95 * words)


def _pairwise(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    return _pairwise(indel)(a, b)


def weighted_ratio(a: Column, b: Column) -> Column:
    return _pairwise(wratio)(a, b)


def lcs_sql(a: str, b: str) -> str:
    """LCS by dynamic programming in SQL, for short strings: stays in the JVM."""
    return (f"element_at(aggregate(split({a}, ''), array_repeat(0, length({b}) + 1), (row, x) -> aggregate(sequence(1, length({b})), array(0), (acc, j) -> "
            f"concat(acc, array(if(substring({b}, j, 1) = x, row[j - 1] + 1, greatest(row[j], acc[j - 1])))))), -1)")


def plural_pair(a: Column, b: Column) -> Column:
    """Either side is the other and e, en, n, er or s, or has a / o / u / ag at its end turned into ä / ö / ü / äge."""
    def of(x: Column, y: Column) -> Column:
        out = F.lit(False)
        for s in ("e", "en", "n", "er", "s"):
            out = out | (y == F.concat(x, F.lit(s)))
        for s, t in (("a", "ä"), ("o", "ö"), ("u", "ü"), ("ag", "äge")):
            out = out | (x.endswith(s) & (y == F.concat(F.left(x, F.length(x) - len(s)), F.lit(t))))
        return out

    a, b = F.lower(a), F.lower(b)
    return of(a, b) | of(b, a)


def like_length(a: Column, b: Column, least: float) -> Column:
    """Necessary for an indel ratio of ``least``: LCS is at most the shorter length."""
    return F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * (least / (200 - least))
