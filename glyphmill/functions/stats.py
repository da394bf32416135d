"""Column expressions for intervals, tests and moments, with the guards for empty and constant data."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.959963984540054


def wilson(count: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval of count/n, within [0, 1]; (0, 0) where n is 0."""
    count, n = count.cast("double"), n.cast("double")
    p, denom = F.try_divide(count, n), 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n))
    lo, hi = (centre - half) / denom, (centre + half) / denom
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), lo)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), hi))


def wilson_upper(count: Column, n: Column, z: float = 1.96) -> Column:
    """Upper end of the Wilson interval, not clamped; null where n is 0."""
    count, n = count.cast("double"), n.cast("double")
    p = F.try_divide(count, n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return (p + F.try_divide(F.lit(z * z), 2 * n) + half) / (1 + F.try_divide(F.lit(z * z), n))


def rate_columns(count: Column, n: Column, digits: int = 6) -> list[Column]:
    """rate_per_1000, ci95_lo, ci95_hi of count/n, each per thousand."""
    lo, hi = wilson(count, n)
    rate = F.coalesce(F.try_divide(count.cast("double"), n.cast("double")), F.lit(0.0))
    return [F.round(rate * 1000, digits).alias("rate_per_1000"), F.round(lo * 1000, digits).alias("ci95_lo"), F.round(hi * 1000, digits).alias("ci95_hi")]


def two_proportion_z(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """Pooled z; null where a sample is empty, 0 where the standard error is."""
    c1, n1, c2, n2 = (c.cast("double") for c in (c1, n1, c2, n2))
    p = F.try_divide(c1 + c2, n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(F.try_divide(c1, n1) - F.try_divide(c2, n2), se)
    return F.when((n1 == 0) | (n2 == 0), None).otherwise(F.when(se == 0, 0.0).otherwise(z))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a z value."""
    return z.map(lambda x: None if x is None or math.isnan(x) else 2 * (1 - 0.5 * (1 + math.erf(abs(x) / math.sqrt(2)))))


def skewness(x: Column) -> Column:
    """Population skewness as an aggregate; null below 3 values, 0 for constant ones."""
    n, m1, m2, m3 = F.count(x), F.avg(x), F.avg(x * x), F.avg(x * x * x)
    var = m2 - m1 * m1
    g1 = F.try_divide(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1, F.pow(F.greatest(var, F.lit(0.0)), F.lit(1.5)))
    return F.when(n < 3, None).when(F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0, 0.0).otherwise(g1)


def describe(x: Column) -> list[Column]:
    """n, mean, population sd, exact median, min, max and skewness as aggregates; sd is 0 for one value."""
    x = x.cast("double")
    return [F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(skewness(x), 6).alias("skewness")]


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null if a side is constant or there are fewer than 2 pairs."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) < 2) | (sd == 0), None).otherwise(F.try_divide(F.covar_pop(x, y), sd))


def histogram_bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin [edge, next edge), the last one closed; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        inside = (x >= edges[k]) & ((x < edges[k + 1]) | ((x == edges[-1]) if k == len(edges) - 2 else F.lit(False)))
        out = F.when(inside, k).otherwise(out)
    return out
