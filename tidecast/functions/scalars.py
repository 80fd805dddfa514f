"""Scalar column expressions; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return F.try_divide(num, den)


def cogs_ratio(revenue: Column, cogs: Column) -> Column:
    return ratio(cogs, revenue)


def margin_pct(revenue: Column, cogs: Column) -> Column:
    return ratio(revenue - cogs, revenue) * 100


def pct_change(new: Column, old: Column) -> Column:
    """Change in percent; NULL (not infinity) when the old value is zero."""
    return ratio(new - old, old) * 100


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to constants. ``least``/``greatest`` skip NULLs, so a NULL input is guarded to stay NULL."""
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNotNull(), out)


def cap_by(x: Column, limit: Column) -> Column:
    """Cap one column by another; NULL when either is missing."""
    return F.when(x.isNotNull() & limit.isNotNull(), F.least(x, limit))


def line_revenue(qty: Column, price: Column, discount: Column) -> Column:
    return qty * price - discount


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return ratio(x - mean, std)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the pairs with both sides known; NULL (not an error) when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    return ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def strip_year(title: Column) -> Column:
    """Promotion title without its trailing four-digit year."""
    return F.regexp_replace(title, r"\s*\d{4}$", "")


def settle(x: Column, places: int) -> Column:
    """Round to ``places`` with the cut moved off exact ties.

    Two engines sum doubles in different orders, so results may differ in the last bits; a cut that no
    short decimal lands on gives both the same rounded value.
    """
    unit = 10 ** places
    return F.floor(x * unit + 0.5001) / unit
