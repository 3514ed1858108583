"""Longest common subsequence, bit-parallel over arbitrary-length integers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two token sequences.

    One big-integer step a token of ``b`` over a bit row as long as ``a``; exact
    for sequences of any length, 0 if either is empty.
    """
    if not len(a) or not len(b):
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def _recall(answer: pd.Series, reasoning: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(a, r) / len(a) if a is not None and r is not None and len(a) and len(r) else 0.0 for a, r in zip(answer, reasoning)], dtype="float64")


def lcs_recall(answer_tokens: Column, reasoning_tokens: Column) -> Column:
    """Share of the answer's tokens found, in order, in the reasoning.

    0 where either array is null or empty. An Arrow UDF, since no built-in
    expression has a sequence alignment.
    """
    return _recall(answer_tokens, reasoning_tokens)
