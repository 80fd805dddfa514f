"""Forecasts that need no fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidecast.functions.scalars import pct_change, ratio
from tidecast.operators.spine import KEYS
from tidecast.operators.windows import lag_days, lagged_mean, year_stat


def yoy_naive(df: DataFrame, col: str = "revenue", days: int = 365, keys=KEYS, name: str = "pred") -> DataFrame:
    return df.withColumn(name, lag_days(F.col(col), days, keys))


def naive_structure(df: DataFrame, col: str = "revenue", keys=KEYS) -> DataFrame:
    """Model-free stand-in for the structural model: last year's value, and last year's mean as trend."""
    return (df.withColumn("structural_pred", lag_days(F.col(col), 365, keys))
              .withColumn("structural_trend", lagged_mean(F.col(col), 365, 365, keys)))


def annual_totals(df: DataFrame, columns=("revenue", "cogs"), keys=KEYS) -> DataFrame:
    return df.groupBy(*keys, F.year("ds").alias("year")).agg(
        *[F.sum(c).alias(c) for c in columns], F.count("*").alias("days"))


def annual_change(annual: DataFrame, col: str, keys=KEYS) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("year")
    return annual.withColumn("change_pct", pct_change(F.col(col), F.lag(col).over(w)))


def geo_growth(annual: DataFrame, columns=("revenue", "cogs"), keys=KEYS, min_days: int = 360) -> DataFrame:
    """Geometric mean growth factor over full years, one column per target."""
    full = annual.where(F.col("days") >= min_days)
    w = W.partitionBy(*keys).orderBy("year")
    steps = full.select(*keys, *[F.log(ratio(F.col(c), F.lag(c).over(w))).alias(c) for c in columns])
    return steps.groupBy(*keys).agg(*[F.exp(F.avg(c)).alias(f"{c}_growth") for c in columns])


def seasonal_profile(df: DataFrame, columns=("revenue", "cogs"), keys=KEYS) -> DataFrame:
    """Mean of value / annual mean per (month, day)."""
    normed = df.select(*keys, F.month("ds").alias("month"), F.dayofmonth("ds").alias("day"),
                       *[ratio(F.col(c), year_stat(F.col(c), "mean", keys)).alias(c) for c in columns])
    return normed.groupBy(*keys, "month", "day").agg(*[F.avg(c).alias(f"{c}_profile") for c in columns])


def profile_forecast(history: DataFrame, days: DataFrame, base_year: int, columns=("revenue", "cogs"),
                     keys=KEYS) -> DataFrame:
    """Base-year level × growth^years ahead × seasonal profile (1.0 where the day was never seen).

    A series without the base year, or with too few full years for a growth, keeps its days with NULL forecasts.
    """
    annual = annual_totals(history, columns, keys)
    base = annual.where(F.col("year") == base_year).select(
        *keys, *[(F.col(c) / 365).alias(f"{c}_base") for c in columns])
    level = base.join(geo_growth(annual, columns, keys), list(keys))
    out = days.withColumn("month", F.month("ds")).withColumn("day", F.dayofmonth("ds"))
    out = out.join(level, list(keys), "left").join(seasonal_profile(history, columns, keys), [*keys, "month", "day"], "left")
    ahead = F.year("ds") - base_year
    preds = [(F.col(f"{c}_base") * F.pow(f"{c}_growth", ahead) * F.coalesce(f"{c}_profile", F.lit(1.0)))
             .alias(f"{c}_pred") for c in columns]
    return out.select(*keys, "ds", *preds)
