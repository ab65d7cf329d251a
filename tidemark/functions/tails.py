"""Tail probabilities of test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: up to this size of the larger sample the exact law is used.
EXACT_UP_TO = 10_000


def kolmogorov_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value as a column.

    2 * sum (-1)^(k-1) exp(-2 k^2 x^2) with x = D * sqrt(n1 n2 / (n1 + n2)).
    Below x = 0.2 the value is 1 to fourteen digits and the series slow.
    """
    x2 = statistic * statistic * (n1 * n2 / (n1 + n2))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(k * k * x2 * -2.0),
    )
    p = F.greatest(F.least(terms * 2.0, F.lit(1.0)), F.lit(0.0))
    return F.when(x2 < 0.04, F.lit(1.0)).otherwise(p)


def kolmogorov_exact_p(n1: int, n2: int, statistic: float) -> float:
    """P(D >= statistic) of two samples of one continuous law: lattice paths that leave the band.

    Every order of the pooled values is a path from (0, 0) to (n1, n2). `out[i]` is the share of the
    paths through (i, k - i) that were outside the band |i/n1 - j/n2| < D before or there; a
    path comes to a point from the left with probability i/k. Points outside have share 1, so only those
    inside are kept: n1 + n2 steps of a vector as wide as the band. Shares are added, never
    subtracted, so small p-values keep their digits.
    """
    reach = round(statistic * n1 * n2)
    if reach <= 0 or not n1 or not n2:
        return 1.0
    size, low, out = n1 + n2, 0, np.zeros(1)
    for k in range(1, size + 1):
        first = max((k * n1 - reach) // size + 1, k - n2, 0)
        last = min(-((-k * n1 - reach) // size) - 1, n1, k)
        if last < first:
            return 1.0
        i = np.arange(first, last + 1)
        # points of the step before, from first - 1 to last; those it did not keep are outside
        before = np.ones(len(i) + 1)
        a, b = max(first - 1, low), min(last, low + len(out) - 1)
        if b >= a:
            before[a - first + 1 : b - first + 2] = out[a - low : b - low + 1]
        out = (before[:-1] * i + before[1:] * (k - i)) / k
        low = first
    return float(min(out[0], 1.0))


def _exact_p(n1: pd.Series, n2: pd.Series, statistic: pd.Series) -> pd.Series:
    """Null for samples over the exact law's size and for unknown statistics."""
    rows = zip(n1, n2, statistic, strict=True)
    small = lambda a, b, d: d == d and d is not None and max(a, b) <= EXACT_UP_TO
    return pd.Series([kolmogorov_exact_p(int(a), int(b), d) if small(a, b, d) else None for a, b, d in rows], dtype="float64")


def two_sample_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Two-sample Kolmogorov-Smirnov p-value: exact for small samples, else asymptotic.

    Only for tables of results, one row a test: the exact law is worked out row by row.
    """
    exact = F.pandas_udf(_exact_p, DoubleType())
    p = F.coalesce(exact(n1, n2, statistic), kolmogorov_p(statistic, n1, n2))
    return F.when(statistic.isNotNull(), p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (Lentz's method)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total / a


def student_two_sided_p(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))
