"""Least-squares polynomials of degree 1 to 3 per group, without Python.

Days are mapped to ``v`` in [-1, 1] and values are centred before power sums
are taken, which keeps the normal equations well conditioned.  Eliminating the
intercept leaves a symmetric 3x3 system; its factors are shared by the three
degrees, and every pivot gives the gain in R-squared of one more degree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_DAYS = 5
# Mean square of the spread, relative to the mean, up to which a series is constant.
FLAT = 1e-22
DEGREE_NAMES = {1: "linear", 2: "polynomial_2", 3: "polynomial_3"}


def power_sums(
    series: DataFrame, keys: Sequence[str], used: Column, value: str, date: str = "Date"
) -> DataFrame:
    """One row per key with everything a fit needs.

    ``series`` has at most one row per day and key; rows that are not ``used``
    only make sure that their key appears.
    """
    group = W.partitionBy(*keys)
    day = F.when(used, F.col(date))
    y = F.when(used, F.col(value))
    scaled = series.select(
        *keys,
        day.alias("_day"),
        y.alias("_y"),
        F.min(day).over(group).alias("first_day"),
        F.max(day).over(group).alias("_newest"),
        F.avg(y).over(group).alias("y_mean"),
    )
    span = F.datediff("_newest", "first_day")
    v = 2.0 * F.datediff("_day", "first_day") / F.nullif(span, F.lit(0)) - 1.0
    points = scaled.select(
        *keys,
        "first_day",
        "y_mean",
        "_day",
        "_y",
        (F.col("_y") - F.col("y_mean")).alias("_yc"),
        v.alias("_v"),
        span.alias("_span"),
    )
    v, yc = F.col("_v"), F.col("_yc")
    powers = {1: v, 2: v * v}
    for k in range(3, 7):
        powers[k] = powers[k // 2] * powers[k - k // 2]
    return points.groupBy(*keys).agg(
        F.count("_y").alias("data_points"),
        F.min("first_day").alias("first_day"),
        F.max("_span").alias("last_day"),
        F.max("y_mean").alias("y_mean"),
        F.max_by("_y", "_day").alias("current_1rm"),
        F.sum(yc * yc).alias("yy"),
        *[F.sum(p).alias(f"m{k}") for k, p in powers.items()],
        *[F.sum(yc * powers[k]).alias(f"b{k}") for k in (1, 2, 3)],
    )


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def solve(sums: DataFrame) -> DataFrame:
    """Add the factors of the system and ``r2_1``, ``r2_2``, ``r2_3``.

    Each step is its own projection so that no expression is repeated.
    """
    c = F.col
    n = F.nullif(c("data_points"), F.lit(0))
    # values that differ by rounding only are one constant: no slope, no curve
    flat = c("yy") <= n * c("y_mean") * c("y_mean") * FLAT
    level = {k: F.when(flat, 0.0).otherwise(c(k)) for k in ("yy", "b1", "b2", "b3")}

    def centred(j: int, k: int) -> Column:
        return c(f"m{j + k}") - c(f"m{j}") * c(f"m{k}") / n

    steps = [
        level,
        {
            "d1": centred(1, 1),
            "a12": centred(1, 2),
            "a13": centred(1, 3),
            "a22": centred(2, 2),
            "a23": centred(2, 3),
            "a33": centred(3, 3),
        },
        {"l21": _ratio(c("a12"), c("d1")), "l31": _ratio(c("a13"), c("d1"))},
        {
            "d2": c("a22") - c("l21") * c("a12"),
            "e23": c("a23") - c("l21") * c("a13"),
            "z2": c("b2") - c("l21") * c("b1"),
        },
        {"l32": _ratio(c("e23"), c("d2"))},
        {
            "d3": c("a33") - c("l31") * c("a13") - c("l32") * c("e23"),
            "z3": c("b3") - c("l31") * c("b1") - c("l32") * c("z2"),
        },
        {
            "g1": _ratio(c("b1"), c("d1")),
            "g2": _ratio(c("z2"), c("d2")),
            "g3": _ratio(c("z3"), c("d3")),
        },
    ]
    out = sums
    for step in steps:
        out = out.withColumns(step)
    # a constant series is met exactly by any degree
    gains = {1: c("g1") * c("b1"), 2: c("g2") * c("z2"), 3: c("g3") * c("z3")}
    r2, total = {}, F.lit(0.0)
    for k, gain in gains.items():
        total = total + gain
        r2[f"r2_{k}"] = F.when(c("yy") == 0, 1.0).otherwise(
            F.least(F.lit(1.0), _ratio(total, c("yy")))
        )
    return out.withColumns(r2)


def coefficients(solved: DataFrame, degree: Column) -> DataFrame:
    """Coefficients ``p0..p3`` in ``v`` of the chosen degree, and the slope per
    day of the straight line."""
    c = F.col
    n = F.nullif(c("data_points"), F.lit(0))
    steps = [
        {"degree": degree},
        {"p3": F.when(c("degree") >= 3, c("g3")).otherwise(0.0)},
        {
            "p2": F.when(c("degree") >= 2, c("g2") - c("l32") * c("p3")).otherwise(0.0)
        },
        {"p1": c("g1") - c("l21") * c("p2") - c("l31") * c("p3")},
        {
            "p0": c("y_mean")
            - (c("p1") * c("m1") + c("p2") * c("m2") + c("p3") * c("m3")) / n,
            "slope": 2.0 * c("g1") / F.nullif(c("last_day"), F.lit(0)),
        },
    ]
    out = solved
    for step in steps:
        out = out.withColumns(step)
    return out


def predict(day: Column) -> Column:
    """Value of the fitted polynomial ``day`` days after the first day."""
    v = 2.0 * day / F.col("last_day") - 1.0
    return F.col("p0") + v * (F.col("p1") + v * (F.col("p2") + v * F.col("p3")))
