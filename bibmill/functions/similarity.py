"""Similarities of two strings, over sets of words unless named otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import soft, tokens


def rounded(c: Column, places: int = 4) -> Column:
    """Half up, as the scores are meant; Spark's round goes away from zero."""
    return F.floor(c * 10**places + 0.5) / 10**places


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.coalesce(F.try_divide(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


@F.pandas_udf(T.DoubleType())
def dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dice coefficient of the multisets of character pairs."""
    from collections import Counter

    def one(x, y):
        x, y = (Counter(t[i: i + 2] for i in range(len(t) - 1)) for t in (x or "", y or ""))
        both = sum(x.values()) + sum(y.values())
        return 2 * sum((x & y).values()) / both if both else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's ratio of the soft forms: twice the characters in common
    substrings, the longest first, by both lengths; 1 for two empty ones. For fields and
    references: its work grows with the product of the lengths."""
    return _matched(soft(a), soft(b))
