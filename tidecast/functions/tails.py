"""Tail probabilities for test statistics.

Spark SQL has no normal, Student or chi-square tail, so these small pandas UDFs run on the handful of
aggregated rows that hold test statistics, never on raw rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the tail inwards."""
    value = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1.0 + odd / (1.0 + value))
    first = -(a + b) * x / (a + 1)
    return 1.0 / (1.0 + first / (1.0 + value))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi_square_upper(x: float, df: float) -> float:
    """Upper tail of chi-square: series below the mean, continued fraction above it."""
    if x <= 0.0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= y / k
            total += term
        return max(0.0, 1.0 - front * total)
    value = 0.0
    for m in range(300, 0, -1):
        value = m * (a - m) / (y + 2 * m + 1 - a + value)
    return front / (y + 1 - a + value)


def _optional(value) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if _optional(v) else normal_two_sided(v))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of ``n`` pairs through Student's t."""
    def one(rv, nv):
        if _optional(rv) or nv < 3:
            return None
        if abs(rv) >= 1.0:
            return 0.0
        return student_two_sided(rv * math.sqrt((nv - 2) / (1.0 - rv * rv)), nv - 2)
    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if _optional(a) else chi_square_upper(a, b) for a, b in zip(h, df)], dtype="float64")
