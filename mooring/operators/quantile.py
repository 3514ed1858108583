"""Exact quantiles of columns of any size, in one plan of three passes.

The built-in exact percentile keeps every distinct value in one buffer, and the
approximate one is off by a bounded rank error. Here the approximate one brackets
the quantile twice: first between two values whose ranks enclose it by twice the
error; then, among the rows between these, between two of a grid of percentiles.
What lies between those is counted by value and sorted: of ``n`` rows at most about
``n / 80_000`` distinct values, so a billion rows leave twelve thousand. Ties count
as one value. The brackets are single rows, the same for every size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.functions.metrics import finite

#: Of the approximate percentile; its rank error is at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Steps of the second bracket's grid.
GRID = 100


def _between(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def quantiles(df: DataFrame, columns: list[str], q: float) -> DataFrame:
    """One row with the exact quantile of each column's finite values (null if it has none).

    Linearly interpolated between the two values around rank ``(n - 1) q``.
    ``df`` is read three times, all columns at once: pass a frame that is cut
    off from a costly lineage.
    """
    cs = [f"c{i}" for i in range(len(columns))]
    rows = df.select(*[F.when(finite(F.col(c)), F.col(c).cast("double")).alias(n) for n, c in zip(cs, columns)])
    slack = 2.0 / ACCURACY
    one = rows.agg(*[F.count(n).alias(f"n_{n}") for n in cs], *[F.percentile_approx(n, [max(0.0, q - slack), min(1.0, q + slack)], ACCURACY).alias(f"p_{n}") for n in cs], *[F.min(n).alias(f"l_{n}") for n in cs], *[F.max(n).alias(f"h_{n}") for n in cs])

    def ends(n: str) -> tuple[Column, Column]:
        # of few rows the slack holds no neighbour, so all of them are inside
        few = F.col(f"n_{n}") * (slack / 2) < 2
        low = F.when(few | F.lit(q - slack <= 0), F.col(f"l_{n}")).otherwise(F.get(f"p_{n}", F.lit(0)))
        return low, F.when(few | F.lit(q + slack >= 1), F.col(f"h_{n}")).otherwise(F.get(f"p_{n}", F.lit(1)))

    one = one.select(*[F.col(f"n_{n}") for n in cs], *[x.alias(f"{k}_{n}") for n in cs for k, x in zip(("low", "high"), ends(n))])

    inside = {n: F.when(_between(F.col(n), F.col(f"low_{n}"), F.col(f"high_{n}")), F.col(n)) for n in cs}
    grid = [i / GRID for i in range(GRID + 1)]
    two = rows.crossJoin(F.broadcast(one)).groupBy(*one.columns).agg(*[F.count_if(F.col(n) < F.col(f"low_{n}")).alias(f"below_{n}") for n in cs], *[F.count(inside[n]).alias(f"m_{n}") for n in cs], *[F.percentile_approx(inside[n], grid, ACCURACY).alias(f"g_{n}") for n in cs])

    def narrowed(n: str) -> tuple[Column, Column]:
        """The grid values around the place of the quantile among the rows inside, one step off on both sides."""
        at = ((F.col(f"n_{n}") - 1) * q - F.col(f"below_{n}")) / F.greatest(F.col(f"m_{n}") - 1, F.lit(1)) * GRID
        off = F.lit(1) + F.ceil(F.lit(2.0) * GRID / F.greatest(F.col(f"m_{n}"), F.lit(1)))
        low, high = F.floor(at) - off, F.ceil(at) + off
        return F.when(low <= 0, F.col(f"low_{n}")).otherwise(F.get(f"g_{n}", low.cast("int"))), F.when(high >= GRID, F.col(f"high_{n}")).otherwise(F.get(f"g_{n}", high.cast("int")))

    two = two.select(*[F.struct(((F.col(f"n_{n}") - 1) * q).alias("at"), *[x.alias(k) for k, x in zip(("low", "high"), narrowed(n))]).alias(f"b_{n}") for n in cs])
    each = F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).alias("x"), F.col(f"b_{n}").alias("b")) for n in cs])
    values = rows.crossJoin(F.broadcast(two)).select(F.explode(F.filter(each, lambda e: e["x"] <= e["b"]["high"])).alias("e"))
    # all values below the bracket count as one, the null one
    counts = values.select("e.c", "e.b.at", F.when(F.col("e.x") >= F.col("e.b.low"), F.col("e.x")).alias("x")).groupBy("c", "at", "x").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c").orderBy(F.col("x").asc_nulls_first())))
    k = F.floor("at")
    around = upto.groupBy("c", "at").agg(F.min(F.when(F.col("upto") > k, F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > k + 1, F.col("x"))).alias("z"))
    value = F.col("a") + F.coalesce((F.col("z") - F.col("a")) * (F.col("at") - k), F.lit(0.0))
    got = around.select("c", value.alias("v"))
    return got.agg(*[F.max(F.when(F.col("c") == n, F.col("v"))).alias(c) for n, c in zip(cs, columns)])
