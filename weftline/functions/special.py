"""Distribution tails and digamma as Spark expressions or small numpy helpers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def digamma_int(n: Column) -> Column:
    """digamma at positive integers: short sums exactly, else the asymptotic series."""
    x = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(16)) - 1)),
        F.lit(0.0),
        lambda acc, k: acc + F.lit(1.0) / k,
    ) - EULER
    i2 = 1 / (x * x)
    series = F.ln(x) - 0.5 / x - i2 * (1 / 12.0 - i2 * (1 / 120.0 - i2 * (1 / 252.0 - i2 * (1 / 240.0 - i2 / 132.0))))
    return F.when(n <= 1, F.lit(-EULER)).when(n < 16, small).otherwise(series)


def digamma(n: np.ndarray) -> np.ndarray:
    """digamma for positive integer arrays."""
    n = np.asarray(n, dtype=np.int64)
    table = np.concatenate([[np.nan, -EULER], -EULER + np.cumsum(1.0 / np.arange(1, 64))])
    x = np.maximum(n, 1).astype(float)
    i2 = 1 / (x * x)
    series = np.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    return np.where(n < 64, table[np.minimum(n, 64)], series)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not (f > 0) or d1 <= 0 or d2 <= 0:
        return 1.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution."""
    if not (x > 0):
        return 1.0
    a, z = k / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        m = a
        while abs(term) > abs(total) * 1e-16:
            m += 1
            term *= z / m
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b, c = z + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
