"""Exogenous table and the 23-column future-safe feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidecast.fixed_values import (CALENDAR_EXTRA_FEATURES, CALENDAR_FEATURES, EXOG_ANCHOR_FEATURES, EXOG_FEATURES,
                                   REGIME_FEATURES)
from tidecast.functions.calendar import calendar_columns
from tidecast.operators.spine import KEYS, daily_total, monthly_mean, monthly_to_daily
from tidecast.operators.windows import lag_days, lagged_mean

EXOG = ("sessions", "overstock_pct", "days_of_supply", "fill_rate")


def exog_table(spine: DataFrame, traffic: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(ds, sessions, overstock_pct, days_of_supply, fill_rate): one row per calendar day of ``spine``."""
    sessions = daily_total(traffic, ["sessions"])
    monthly = monthly_mean(snapshots.withColumnRenamed("overstock_flag", "overstock_pct"),
                           ["overstock_pct", "days_of_supply", "fill_rate"])
    daily = monthly_to_daily(monthly, spine, ["overstock_pct", "days_of_supply", "fill_rate"])
    return daily.join(sessions, "ds", "left").select("ds", *EXOG)


def exog_lags(exog: DataFrame) -> DataFrame:
    """(ds, …_lag365, …_lag730): drivers as they were one and two years before each day.

    Lags are taken once on the driver table, which has one row per calendar day, not once per series.
    """
    company = [F.lit("company")]
    lagged = [lag_days(F.col(c), 365, company).alias(f"{c}_lag365") for c in EXOG]
    lagged += [lag_days(F.col(c), 730, company).alias(f"{c}_lag730") for c in ("fill_rate", "sessions")]
    return exog.select("ds", *lagged)


def with_exog(panel: DataFrame, exog: DataFrame) -> DataFrame:
    """Company-level drivers for every series. One row per calendar day, so the table is bounded and broadcast."""
    return panel.join(F.broadcast(exog), "ds", "left")


def feature_columns(residual: Column, keys=KEYS) -> list[Column]:
    """Residual lags and calendar as expressions over one window layout: all lags and means share a single sort.

    Residuals are read at least 364 days back; the rest is known calendar.
    """
    ds = F.col("ds")
    cols = [lag_days(residual, n, keys).alias(f"resid_lag{n}") for n in (365, 364, 366, 730)]
    cols.append(lagged_mean(residual, 365, 28, keys).alias("resid_roll28_lag365"))
    cols += calendar_columns(ds, (*CALENDAR_FEATURES, *CALENDAR_EXTRA_FEATURES, *REGIME_FEATURES))
    return cols


def future_safe_features(df: DataFrame, keys=KEYS, keep=()) -> DataFrame:
    """``df``: (keys, ds, residual, structural_trend, driver lags…) -> keys, ds, ``keep`` and the features.

    With the six driver lags of ``exog_lags`` attached, the result has all 23 features; without them, 17.
    """
    drivers = [c for c in (*EXOG_FEATURES, *EXOG_ANCHOR_FEATURES) if c in df.columns]
    return df.select(*keys, "ds", *keep, "structural_trend", *drivers, *feature_columns(F.col("residual"), keys))
