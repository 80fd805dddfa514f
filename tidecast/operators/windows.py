"""Ordered operators on a panel. All share one layout (see ``spine``): one exchange on the keys, then sorts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.functions.scalars import pct_change, ratio
from tidecast.operators.spine import KEYS, by_calendar, by_day

AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def rolling_column(x: Column, before: int, after: int, fn: str, min_periods: int, keys=KEYS, ds: str = "ds") -> Column:
    """Aggregate over rows −before … +after; NULL while fewer than ``min_periods`` values are present."""
    frame = by_day(keys, ds).rowsBetween(-before, after)
    return F.when(F.count(x).over(frame) >= min_periods, AGGREGATES[fn](x).over(frame))


def rolling(df: DataFrame, col: str, before: int, after: int, fn: str, min_periods: int, name: str,
            keys=KEYS) -> DataFrame:
    return df.withColumn(name, rolling_column(F.col(col), before, after, fn, min_periods, keys))


def centred(window: int) -> tuple[int, int]:
    """Rows before and after the centre; an even window leans one row back."""
    return window // 2, window - 1 - window // 2


def lag_days(x: Column, days: int, keys=KEYS, ds: str = "ds") -> Column:
    """Value exactly ``days`` calendar days earlier, NULL if that day is absent.

    A RANGE frame of one day over the day number: needs no dense index and no self join, and all lags of a
    plan share one sort.
    """
    return F.max(x).over(by_calendar(keys, ds).rangeBetween(-days, -days))


def lag_calendar(df: DataFrame, columns, days: int, keys=KEYS, suffix: str | None = None) -> DataFrame:
    suffix = suffix if suffix is not None else f"_lag{days}"
    return df.select("*", *[lag_days(F.col(c), days, keys).alias(f"{c}{suffix}") for c in columns])


def lagged_mean(x: Column, lag: int, width: int, keys=KEYS, ds: str = "ds") -> Column:
    """Mean of the ``width`` days that end ``lag`` days ago; at least one value."""
    return F.avg(x).over(by_calendar(keys, ds).rangeBetween(-lag - width + 1, -lag))


def forward_fill(x: Column, keys=KEYS, ds: str = "ds") -> Column:
    return F.last(x, ignorenulls=True).over(by_day(keys, ds).rowsBetween(W.unboundedPreceding, 0))


def shift_rows(x: Column, k: int, keys=KEYS, ds: str = "ds") -> Column:
    """Row shift: positive looks back, negative looks ahead."""
    return F.lag(x, k).over(by_day(keys, ds))


def band(df: DataFrame, col: str, window: int = 90, n_sigma: float = 2.0, keys=KEYS) -> DataFrame:
    """Trailing mean ± n·σ and a one-sided flag for values above the band."""
    mean = rolling_column(F.col(col), window - 1, 0, "mean", window, keys)
    std = rolling_column(F.col(col), window - 1, 0, "std", window, keys)
    out = df.withColumn("band_mean", mean).withColumn("band_std", std)
    upper = F.col("band_mean") + n_sigma * F.col("band_std")
    lower = F.col("band_mean") - n_sigma * F.col("band_std")
    return out.withColumn("band_upper", upper).withColumn("band_lower", lower).withColumn(
        "is_anomaly", F.coalesce(F.col(col) > F.col("band_upper"), F.lit(False)))


def smooth_recent(df: DataFrame, col: str, name: str, window: int = 14, years: int = 2, keys=KEYS) -> DataFrame:
    """Trailing mean of the last ``years`` years; the mean itself starts inside that cut."""
    last = F.max("ds").over(W.partitionBy(*keys))
    recent = df.withColumn("_last", last).where(F.col("ds") >= F.add_months("_last", -12 * years)).drop("_last")
    return rolling(recent, col, window - 1, 0, "mean", window, name, keys)


def baseline_outside(df: DataFrame, col: str, flag: str, window: int = 30, keys=KEYS) -> DataFrame:
    """Rolling mean over unflagged rows only, carried forward over flagged ones, and the lift against it.

    The mean over "the last 30 unflagged rows" is a row frame inside the unflagged half of the series, so both
    halves are windowed together by partitioning on the flag too.
    """
    frame = W.partitionBy(*keys, flag).orderBy("ds").rowsBetween(-(window - 1), 0)
    own = F.when((F.col(flag) == 0) & (F.count(col).over(frame) >= window), F.avg(col).over(frame))
    out = df.withColumn("_own", own).withColumn("baseline", forward_fill(F.col("_own"), keys)).drop("_own")
    return out.withColumn("lift_pct", (ratio(F.col(col), F.col("baseline")) - 1) * 100)


def yoy_change(x: Column, days: int = 365, keys=KEYS) -> Column:
    return pct_change(x, lag_days(x, days, keys))


def year_stat(x: Column, fn: str, keys=KEYS, ds: str = "ds") -> Column:
    """Per-year statistic repeated on every row of the year."""
    return AGGREGATES[fn](x).over(W.partitionBy(*keys, F.year(ds)))
