"""Functions that no Spark expression gives: Arrow-batched UDFs over the standard library."""

from __future__ import annotations

import difflib
from collections import Counter
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (null counts as empty)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    """Whether the ratio is above the limit: by the characters that both have, if they say no, else by matching blocks.  Null pairs are settled already."""

    def judge(x: str | None, y: str | None, least: float) -> bool:
        if x is None or y is None:
            return False
        total = len(x) + len(y)
        if x == y:
            return least < 1.0
        if 2.0 * (Counter(x) & Counter(y)).total() / total <= least:
            return False
        return difflib.SequenceMatcher(None, x, y).ratio() > least

    return pd.Series([judge(x, y, z) for x, y, z in zip(a, b, limit, strict=True)], dtype=bool)


def similar(a: Column, b: Column, limit: float) -> Column:
    """similarity_ratio(a, b) > limit, of which most pairs are settled by bounds.

    2 x shorter / both lengths bounds the ratio, and so do the characters that both have; matching blocks are sought only beyond both.
    """
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    total = F.length(x) + F.length(y)
    open_ = (total > 0) & (2.0 * F.least(F.length(x), F.length(y)) / F.greatest(total, F.lit(1)) > limit)
    both_empty = (total == 0) & F.lit(limit < 1.0)
    return both_empty | _similar(F.when(open_, x), F.when(open_, y), F.lit(float(limit)))


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(base, link, strict=True)])


def display_pair(body: Column, other: Column, limit: float = 0.85) -> Column:
    """struct(first, second): both texts, or one where the other is missing or nearly the same."""
    none, empty = F.lit(None).cast("string"), lambda c: c.isNull() | (c == "")
    pair = lambda x, y: F.struct(x.alias("first"), y.alias("second"))
    return F.when(empty(other), pair(body, none)).when(empty(body), pair(other, none)).when(similar(body, other, limit), pair(body, none)).otherwise(pair(body, other))
