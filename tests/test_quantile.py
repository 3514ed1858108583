import numpy as np
import pytest

from mooring.operators import quantile as Q


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "one", "tail", "large"])
def test_exact(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300_000 if kind == "large" else 4000)
    x = {"normal": x, "ties": np.round(x, 1), "two": (x > 0) * 1.0, "one": x * 0 + 3, "tail": np.exp(9 * x), "large": x}[kind]
    pdf = __import__("pandas").DataFrame({"x": x, "y": -x})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, None), (float("nan"), 1e9), (float("inf"), None)], "x double, y double").where("y is null")).repartition(3)
    for q in (0.0, 0.137, 0.6, 1.0):
        got = Q.quantiles(df, ["x", "y"], q).first()
        assert (got.x, got.y) == pytest.approx((np.quantile(x, q), np.quantile(-x, q)), rel=1e-12)


def test_few_values_and_none(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None)], "x double, y double")
    assert tuple(Q.quantiles(df, ["x", "y"], 0.6).first()) == (pytest.approx(1.6), None)
    assert tuple(Q.quantiles(df.where("false"), ["x", "y"], 0.6).first()) == (None, None)


def test_little_is_left_to_sort(spark):
    """What the last pass sorts is a small part of the rows, found by the same plan at every size."""
    df = spark.range(400_000).selectExpr("cast(id as double) as x")
    plan = Q.quantiles(df, ["x"], 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("percentile_approx") >= 2
    assert Q.quantiles(df, ["x"], 0.6).first().x == pytest.approx(399_999 * 0.6)
