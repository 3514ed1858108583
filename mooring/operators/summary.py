"""Summaries of metric records: grouped means, fixed quadrants, quantile zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.functions import metrics as M
from mooring.operators.quantile import quantiles
from mooring.schemas import CONTROL_METHODS, MAIN_METHODS, ZONES

METRICS = ("lexical_anchoring", "entropy_anchoring", "aprob")


def _zones(x: Column, y: Column, x_cut: Column, y_cut: Column) -> dict[str, Column]:
    """Conditions of the four zones; NaN and null are in none."""
    number = ~(F.isnan(x) | F.isnan(y)) & x.isNotNull() & y.isNotNull()
    low_x, low_y = x < x_cut, y < y_cut
    return {z: number & a & b for z, (a, b) in zip(ZONES, ((low_x, low_y), (low_x, ~low_y), (~low_x, low_y), (~low_x, ~low_y)))}


def aggregate(records: DataFrame, by: str = "method", numeric: Sequence[str] = METRICS, x: str = "entropy_anchoring", y: str = "aprob", cut: float = 0.5) -> DataFrame:
    """Means and fixed-threshold quadrants by any field.

    ``group, N, skipped_nan, mean_<field>..., Reason, Encode, Cloze, Copy``. A record
    with a non-finite value is skipped whole and counted; nulls count as absent
    fields. A null group is ``unknown``; groups without any ``y`` left vanish.
    Quadrants are shares of the kept records and null if ``x`` and ``y`` differ in number.
    """
    bad = F.coalesce(F.greatest(*[(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) & F.col(c).isNotNull() for c in numeric], F.lit(False)), F.lit(False))
    value = {c: F.when(~F.col("_bad"), F.col(c)) for c in dict.fromkeys((*numeric, x, y))}
    zones = _zones(value[x], value[y], F.lit(cut), F.lit(cut))
    g = records.select(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("group"), *dict.fromkeys((*numeric, x, y)), bad.alias("_bad")).groupBy("group").agg(
        F.count(value[y]).alias("N"), F.count_if("_bad").alias("skipped_nan"), *[F.avg(value[c]).alias(f"mean_{c}") for c in numeric], F.count(value[x]).alias("_nx"), *[F.count_if(c).alias(z) for z, c in zones.items()],
    )
    return g.where("N > 0").select("group", "N", "skipped_nan", *[f"mean_{c}" for c in numeric], *[F.when(F.col("_nx") == F.col("N"), F.col(z) / F.col("N")).alias(z) for z in ZONES])


def aggregate_all_numeric(records: DataFrame, by: str = "method", y: str = "aprob", x: str = "entropy_anchoring") -> DataFrame:
    """:func:`aggregate` over every floating or integer column but ``sample_idx``."""
    numeric = [f.name for f in records.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)) and f.name not in ("sample_idx", by)]
    return aggregate(records.select(by, *[F.col(c).cast("double").alias(c) for c in numeric]), by, numeric, x, y)


def scale(records: DataFrame, y: str = "aprob") -> DataFrame:
    """Records with the square root of the clipped ``y``."""
    return records.withColumn(y, M.scaled(F.col(y)))


def thresholds(records: DataFrame, quantile: float = 0.6, x: str = "entropy_anchoring", y: str = "aprob") -> DataFrame:
    """One row ``quantile, x_threshold, y_threshold`` of all methods pooled, over finite values.

    Exact, linearly interpolated quantiles (see :mod:`mooring.operators.quantile`),
    for which ``records`` is read three times; an error if a column has no finite value.
    """
    some = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("no finite value to take a quantile of")).cast("double"))
    return quantiles(records, [x, y], quantile).select(F.lit(quantile).alias("quantile"), some(x).alias("x_threshold"), some(y).alias("y_threshold"))


def zones(records: DataFrame, quantile: float = 0.6, lexical: str = "lexical_anchoring", x: str = "entropy_anchoring", y: str = "aprob", scaled: bool = False) -> DataFrame:
    """``method, N, Alex, Aent, Aprob, Reason, Encode, Cloze, Copy, x_threshold, y_threshold`` in percent.

    ``y`` is scaled first unless it already is. N counts all rows; a NaN makes its
    mean NaN and is in no zone. Records without a method count for the thresholds
    only. The thresholds are one row.
    """
    rows = records if scaled else scale(records, y)
    t = thresholds(rows, quantile, x, y)
    cond = _zones(F.col(x), F.col(y), F.col("x_threshold"), F.col("y_threshold"))
    j = rows.where("method is not null").select("method", lexical, x, y).crossJoin(F.broadcast(t.drop("quantile")))  # one row
    return j.groupBy("method", "x_threshold", "y_threshold").agg(
        F.count("*").alias("N"), *[(100 * F.avg(c)).alias(n) for n, c in (("Alex", lexical), ("Aent", x), ("Aprob", y))], *[(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))).alias(z) for z, c in cond.items()],
    ).select("method", "N", "Alex", "Aent", "Aprob", *ZONES, "x_threshold", "y_threshold")


def zone_points(records: DataFrame, quantile: float = 0.6, lexical: str = "lexical_anchoring", x: str = "entropy_anchoring", y: str = "aprob") -> DataFrame:
    """Data of the figure: ``method, x, y, c, zone`` for every record; NaN points have no zone."""
    rows = scale(records, y)
    t = thresholds(rows, quantile, x, y)
    cond = _zones(F.col(x), F.col(y), F.col("x_threshold"), F.col("y_threshold"))
    zone = F.coalesce(*[F.when(c, F.lit(z)) for z, c in cond.items()])
    return rows.crossJoin(F.broadcast(t.drop("quantile"))).select("method", F.col(x).alias("x"), F.col(y).alias("y"), F.col(lexical).alias("c"), zone.alias("zone"))


def figure_cells(points: DataFrame, bins: int = 200) -> DataFrame:
    """``method, x, y, c, n``: the points of :func:`zone_points` on a grid finer than a page shows, with their number and mean ``c``.

    Every point with two finite coordinates counts; those outside 0 to 1 lie on the
    edge. At most ``bins ** 2`` rows a method come out.
    """
    cell = lambda v: F.least(F.greatest(F.floor(F.col(v) * bins), F.lit(0)), F.lit(bins - 1))
    shown = points.where(M.all_finite(F.col("x"), F.col("y")) & F.col("method").isNotNull())
    g = shown.groupBy("method", cell("x").alias("i"), cell("y").alias("j")).agg(F.avg(F.when(M.finite(F.col("c")), F.col("c"))).alias("c"), F.count("*").alias("n"))
    return g.select("method", ((F.col("i") + 0.5) / bins).alias("x"), ((F.col("j") + 0.5) / bins).alias("y"), "c", "n")


def method_order(methods: Sequence[str]) -> list[str]:
    """Main methods only: their order; control methods only: theirs; else known first, rest sorted."""
    own = set(methods)
    known = MAIN_METHODS if own <= set(MAIN_METHODS) else CONTROL_METHODS if own <= set(CONTROL_METHODS) else (*MAIN_METHODS, *CONTROL_METHODS)
    return [m for m in known if m in own] + sorted(own - set(known))


def ordered_methods(records: DataFrame) -> DataFrame:
    """``method, position``: the distinct methods (null is none) in table order, as one plan."""
    m = records.where("method is not null").select("method").distinct()
    known = F.array(*[F.lit(x) for x in (*MAIN_METHODS, *CONTROL_METHODS)])
    at = F.array_position(known, F.col("method"))
    rank = F.when(at > 0, at).otherwise(F.lit(len(MAIN_METHODS) + len(CONTROL_METHODS) + 1))
    g = m.agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "method"))).alias("m"))  # as many entries as methods
    return g.select(F.posexplode("m.method").alias("position", "method")).select("method", "position")


def covers(records: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row ``complete, missing``: does every expected method occur?"""
    known = F.array(*[F.lit(m) for m in expected]).cast("array<string>")
    # only expected methods are gathered, however many others there are
    seen = records.where(F.array_contains(known, F.col("method"))).agg(F.collect_set("method").alias("s"))
    lacking = F.array_sort(F.array_except(known, F.col("s")))
    return seen.select((F.size(lacking) == 0).alias("complete"), lacking.alias("missing"))
