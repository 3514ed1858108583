import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mooring.functions import metrics as M
from mooring.functions.lcs import lcs_length, lcs_recall

NAN, INF = float("nan"), float("inf")


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(row[-1], prev[j + 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=90))
def test_lcs_is_the_table(a, b):
    assert lcs_length(a, b) == dp(a, b) == lcs_length(b, a)
    assert lcs_length(a, b + [0]) >= lcs_length(a, b)


def test_lcs_recall(spark):
    df = spark.createDataFrame([(1, [1, 3, 4, 1], [3, 1, 4, 4, 1]), (2, [], [1]), (3, [1], []), (4, None, [1]), (5, [1, 2], [0, 1, 9, 2]), (6, [7], [1])], "k int, a array<int>, r array<int>")
    assert [r.v for r in df.orderBy("k").select(lcs_recall(F.col("a"), F.col("r")).alias("v")).collect()] == [0.75, 0, 0, 0, 1, 0]


def test_lcs_recall_of_an_empty_table(spark):
    assert spark.createDataFrame([], "a array<string>, r array<string>").select(lcs_recall(F.col("a"), F.col("r"))).count() == 0


@pytest.mark.parametrize("base,final,want", [(-4, -1, 0.75), (-4, -4, 0), (-4, -6, 0), (-4, 0, 1), (0, -1, 0), (NAN, -1, 0), (-4, NAN, NAN), (-INF, -1, NAN), (-4, -INF, 0), (-4, None, 0), (None, -1, 0)])
def test_probabilistic(spark, base, final, want):
    got = spark.createDataFrame([(None if base is None else float(base), None if final is None else float(final))], "b double, f double").select(M.probabilistic_anchoring(F.col("b"), F.col("f")).alias("v")).first().v
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want)


def twin(h, bounds):
    if len(h) < 2:
        return 0.0
    v = np.array([np.mean(h[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a])
    if len(v) < 2:
        return 0.0
    span = v.max() - v.min()
    z = (v - v.min()) / span if span > 1e-9 else np.zeros_like(v)
    d = np.abs(np.diff(z))
    local = np.exp(-d.std() / d.mean()) if d.mean() > 1e-9 else 1.0
    return float(np.sqrt((1 - local) * (1 - min(z.var() / 0.25, 1))))


def entropy(spark, h, bounds):
    return spark.createDataFrame([(h, bounds)], "h array<double>, b array<int>").select(M.entropy_anchoring(F.col("h"), F.col("b")).alias("v")).first().v


@pytest.mark.parametrize(
    "h,bounds,want",
    [
        ([1, 1, 3, 3, 2, 2, 5, 5], [2, 4, 6, 8], 0.348484081),
        ([1, 1, 3, 3, 2, 2, 5, 5], [0, 2, 4, 6, 8], 0.389719451),
        ([1, 5, 1, 5, 2, 8], [0, 1, 2, 3, 4, 5, 6], 0.311002876),
        ([1, 2, 3, 4], [1, 2, 3, 4], 0),
        ([2, 2, 2, 2, 2, 2], [2, 4, 6], 0),
        ([1, 2, 9], [1, 3], 0),
        ([1, NAN, 3, 4], [0, 1, 2, 3, 4], 0),
        ([], [0], 0),
        ([1], [1], 0),
        (None, [1, 2], 0),
        ([1, 2, 3], [], 0),
        ([1, 2, 2, 7, 3], [1, 2, 2, 4, 5], None),
    ],
)
def test_entropic(spark, h, bounds, want):
    h = None if h is None else [float(x) for x in h]
    assert entropy(spark, h, bounds) == pytest.approx(twin(h, bounds) if want is None else want, abs=1e-9)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 9), min_size=4, max_size=30), st.floats(0.5, 20), st.floats(-5, 5))
def test_entropic_properties(spark, h, a, b):
    bounds = [0, *range(2, len(h), 2), len(h)]
    got = entropy(spark, h, bounds)
    assert got == pytest.approx(twin(h, bounds), abs=1e-9) and -1e-9 <= got <= 1 + 1e-9
    if max(h) - min(h) > 1e-3:
        assert entropy(spark, [a * x + b for x in h], bounds) == pytest.approx(got, abs=1e-5)


@pytest.mark.parametrize("n,count,tail", [(0, 1, [0]), (1, 2, [0, 1]), (50, 51, [49, 50]), (51, 52, [50, 51]), (53, 52, [50, 53]), (54, 52, [50, 54]), (55, 53, [54, 55]), (58, 53, [54, 58]), (60, 54, [58, 60]), (-3, 1, [0])])
def test_sampled_steps(spark, n, count, tail):
    got = spark.createDataFrame([(n,)], "n int").select(M.sampled_steps(F.col("n")).alias("s")).first().s
    assert len(got) == count and got[-len(tail) :] == tail


def test_step_ends_and_prefix(spark):
    df = spark.createDataFrame([([2, 3, 1],), ([],)], "s array<int>")
    assert [r.e for r in df.select(M.step_ends(F.col("s"), 1).alias("e")).collect()] == [[2, 6, 8], [0]]
    p = df.select(M.step_ends(F.col("s")).alias("e")).select(*[M.prefix_end(F.col("e"), F.lit(k)).alias(f"p{k}") for k in (0, 1, 3, 9)]).collect()
    assert [tuple(r) for r in p] == [(0, 2, 6, 6), (0, 0, 0, 0)]


def test_window_bounds(spark):
    df = spark.createDataFrame([(120,), (50,), (0,)], "n int")
    assert [r.b for r in df.select(M.window_bounds(F.col("n")).alias("b")).collect()] == [[0, 50, 100, 120], [0, 50], [0, 0]]


def test_finite_and_scaled(spark):
    df = spark.createDataFrame([(0.25,), (-1.0,), (4.0,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    r = df.select(M.finite(F.col("x")).alias("f"), M.scaled(F.col("x")).alias("s")).collect()
    assert [x.f for x in r] == [True, True, True, False, False, False, False]
    assert [None if x.s is None else "nan" if math.isnan(x.s) else x.s for x in r] == [0.5, 0, 1, "nan", 1, 0, None]
