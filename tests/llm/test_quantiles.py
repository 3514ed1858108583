import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import quantiles as Q

PS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def rank_off(x, ps, got):
    x = np.sort(x)
    lo, hi = np.searchsorted(x, got, "left") / len(x), np.searchsorted(x, got, "right") / len(x)
    return max(np.maximum(lo - ps, ps - hi).max(), 0)


@pytest.mark.parametrize("kind", ["lognormal", "ties", "sorted", "constant", "reversed"])
@pytest.mark.parametrize("parts", [1, 7, 400])
def test_rank_error_whatever_the_split(kind, parts):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=120_000)
    x = {"lognormal": x, "ties": np.round(x, 0), "sorted": np.sort(x), "constant": x * 0 + 2, "reversed": -np.sort(x)}[kind]
    whole = Q.Sketch(256, 1)
    for i, p in enumerate(np.array_split(x, parts)):
        s = Q.Sketch(256, i)
        s.update(p)
        whole.merge(Q.Sketch.unpack(s.pack()))
    assert whole.n == len(x) == sum(len(v) << h for h, v in enumerate(whole.levels))
    assert rank_off(x, np.array(PS), whole.quantiles(PS)) <= Q.rank_error(256)


def test_error_bound_holds_in_99_percent():
    misses = 0
    for seed in range(150):
        x = np.random.default_rng(seed).normal(size=30_000)
        s = Q.Sketch(64, seed + 1)
        s.update(x)
        misses += rank_off(x, np.array([0.5]), s.quantiles([0.5])) > Q.rank_error(64)
    assert misses <= 4


def test_exact_up_to_k_values():
    s = Q.Sketch(64, 1)
    s.update(np.arange(60.0))
    assert list(s.quantiles([0.001, 0.5, 1.0])) == [0, 29, 59]


SCHEMA = "method string, day date, aprob double, other string"


def test_nulls_nans_ties_and_empty_groups(spark):
    d = datetime.date(2025, 1, 1)
    rows = [("a", d, float(i), "x") for i in range(100)] + [("a", d, None, "x"), ("a", None, float("nan"), "x"), (None, d, 5.0, "x"), (None, d, 5.0, "x"), ("b", d, float("inf"), None), ("", d, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.method, r.p): r for r in Q.percentiles(Q.sketches(df, ["method"], ["aprob"]), ["method"], [0.5]).collect()}
    assert (got["a", 0.5].value, got["a", 0.5].n_rows, got["a", 0.5].n_finite, got["a", 0.5].max_rank_error) == (49, 102, 100, 0)
    assert got[None, 0.5].value == 5 and got[None, 0.5].n_rows == 2 and got["b", 0.5].value is None and got["b", 0.5].n_rows == 1 and got["", 0.5].value == 1
    assert Q.sketches(df.where("false"), ["method"], ["aprob"]).count() == 0


def test_no_key_and_clashing_names(spark):
    df = spark.createDataFrame([(1.0, "f", 2), (3.0, "g", 3)], "sketch double, field string, part int")
    r = Q.percentiles(Q.sketches(df.select("sketch"), [], ["sketch"]), [], [0.5]).first()
    assert (r.field, r.value, r.n_rows) == ("sketch", 1.0, 2)


def test_days_merge_to_the_whole_and_reruns_agree(spark, small):
    m = spark.read.parquet(f"{small}/metric_records.parquet").repartition(5, "run_id")
    fields = ["aprob", "entropy_anchoring"]
    days = Q.sketches(m, ["method", "run_day"], fields, k=64)
    whole = Q.percentiles(Q.merge_sketches(days, ["method"]), ["method"])
    check = Q.rank_check(m, whole, ["method"]).collect()
    assert check and all(r.within for r in check)
    exact = {r.method: r.n for r in m.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert {r.method: r.n_rows for r in whole.where("field = 'aprob'").collect()} == exact
    a, b = (sorted(map(str, Q.percentiles(Q.sketches(m, ["method"], fields, k=64), ["method"]).collect())) for _ in range(2))
    assert a == b


def test_a_hot_key_over_many_parts(spark):
    df = spark.range(200_000, numPartitions=130).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    s = Q.sketches(df, ["k"], ["v"], k=128)
    r = Q.percentiles(s, ["k"], [0.5]).collect()
    assert s.count() == 1 and r[0].n_finite == 200_000 and abs(r[0].value / 200_000 - 0.5) <= Q.rank_error(128)


def test_many_parts_merge_level_by_level(spark):
    """No task of any level takes more than FAN_IN parts of a group."""
    one = Q.Sketch(16, 1)
    one.update(np.arange(10.0))
    n = Q.FAN_IN**2 + 5
    parts = spark.range(n).select(F.lit("a").alias("k"), F.lit("v").alias("field"), F.col("id").cast("int").alias("part"), F.lit(10).cast("bigint").alias("n_rows"), F.lit(bytearray(one.pack())).alias("sketch"))
    merged = Q.merge_sketches(parts, ["k"], n)
    assert plan(merged).count("Exchange hashpartitioning") == 3
    r = Q.percentiles(merged, ["k"], [0.5]).collect()
    assert [(x.n_finite, x.n_rows) for x in r] == [(10 * n, 10 * n)] and 3 <= r[0].value <= 6
    # finished sketches, all with the same part, are spread first
    again = Q.percentiles(Q.merge_sketches(parts.withColumn("part", F.lit(0)), ["k"]), ["k"], [0.5]).collect()
    assert [x.n_finite for x in again] == [10 * n]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
