"""Outlier capping that spares spikes which recur on the same calendar day of most years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidecast.functions.scalars import z_score
from tidecast.operators.spine import KEYS
from tidecast.operators.windows import centred, rolling_column, year_stat


def detect_recurring(df: DataFrame, col: str, keys=KEYS, z: float = 2.0, share: float = 0.7,
                     name: str = "is_recurring") -> DataFrame:
    """Flag days whose (month, day) spikes (z within its year above ``z``) in at least ``share`` of the years.

    Windows on (keys, year) and (keys, month, day) both fit the layout by keys: no further exchange.
    """
    x = F.col(col)
    score = z_score(x, year_stat(x, "mean", keys), year_stat(x, "std", keys))
    spike = F.when(x.isNotNull(), F.coalesce(score > z, F.lit(False)).cast("int"))
    out = df.withColumn("_spike", spike)
    rate = F.avg("_spike").over(W.partitionBy(*keys, F.month("ds"), F.dayofmonth("ds")))
    return out.withColumn(name, F.coalesce(rate >= share, F.lit(False))).drop("_spike")


def cap_outliers(df: DataFrame, col: str, keys=KEYS, window: int = 30, n_sigma: float = 3.0, min_periods: int = 7,
                 out: str | None = None) -> DataFrame:
    """Cap values above centred mean + n·σ unless recurring. NULL values pass through."""
    out = out or f"clean_{col}"
    before, after = centred(window)
    x = F.col(col)
    upper = (rolling_column(x, before, after, "mean", min_periods, keys)
             + n_sigma * rolling_column(x, before, after, "std", min_periods, keys))
    marked = detect_recurring(df, col, keys, name="_recurring").withColumn("_upper", upper)
    capped = F.when((x > F.col("_upper")) & ~F.col("_recurring"), F.col("_upper")).otherwise(x)
    return marked.withColumn(out, capped).drop("_recurring", "_upper")


def denoise_target(df: DataFrame, targets=("revenue", "cogs"), keys=KEYS) -> DataFrame:
    for t in targets:
        df = cap_outliers(df, t, keys)
    return df


def denoise_report(clean: DataFrame, targets=("revenue", "cogs"), keys=KEYS) -> DataFrame:
    """Mean, maximum and number of capped days per target, before and after; one pass for all targets."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("raw"), F.col(f"clean_{t}").alias("clean")) for t in targets])
    long = clean.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    return long.groupBy(*keys, "target").agg(
        F.count_if(F.abs(F.col("raw") - F.col("clean")) > 1e-6).alias("n_capped"), F.avg("raw").alias("mean_raw"),
        F.avg("clean").alias("mean_clean"), F.max("raw").alias("max_raw"), F.max("clean").alias("max_clean"))
