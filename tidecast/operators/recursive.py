"""Recursive multi-year forecast: each calendar year reads the residuals predicted for the year before."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, functions as F, types as T

from tidecast.operators.features import future_safe_features
from tidecast.operators.joins import patch_update
from tidecast.operators.spine import KEYS
from tidecast.session import shared_folder

Learner = Callable[[DataFrame], DataFrame]


def naive_residual(features: DataFrame) -> DataFrame:
    """Model-free learner: mean of last year's residual and its four-week mean, zero where unknown."""
    guess = (F.coalesce("resid_lag365", F.lit(0.0)) + F.coalesce("resid_roll28_lag365", F.lit(0.0))) / 2
    return features.withColumn("residual_pred", guess)


def year_blocks(start: str, end: str) -> list[tuple[date, date]]:
    lo, hi = date.fromisoformat(start), date.fromisoformat(end)
    return [(max(lo, date(y, 1, 1)), min(hi, date(y, 12, 31))) for y in range(lo.year, hi.year + 1)]


def patch_actual_residuals(state: DataFrame, actual: DataFrame, start: str, end: str, target: str = "revenue",
                           keys=KEYS) -> DataFrame:
    """Write the actual residuals of start…end into ``state`` (keys, ds, residual, structural_pred, …)."""
    fresh = actual.where(F.col("ds").between(start, end)).select(*keys, "ds", F.col(target).alias("_y"))
    joined = state.join(fresh, [*keys, "ds"], "left")
    return joined.withColumn("residual", F.coalesce(F.col("_y") - F.col("structural_pred"), "residual")).drop("_y")


#: Calendar years before a year that its features read: the longest lag is 730 days.
YEARS_BACK = 2


def write_years(rows: DataFrame, folder: str, keys=KEYS) -> None:
    """Rows as Parquet, one partition per calendar year, series spread over the files of a year."""
    rows.withColumn("year", F.year("ds")).repartition("year", *keys).write.mode("append").partitionBy("year").parquet(folder)


def read_years(spark, folder: str, schema: T.StructType, first: int, last: int) -> DataFrame:
    """The years first…last of such a folder; other partitions are not listed in the scan."""
    typed = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    return spark.read.schema(typed).parquet(folder).where(F.col("year").between(first, last)).drop("year")


def recursive_forecast(state: DataFrame, learner: Learner, start: str, end: str, keys=KEYS, folder: str | None = None) -> DataFrame:
    """``state``: (keys, ds, residual, structural_pred, structural_trend, driver lags…) over history and horizon.

    Years run one after the other because a year needs its predecessor's residuals; inside a year all series and
    days are predicted at once. State and predictions are year-partitioned tables in ``folder`` (of the shared folder, if not given): a year scans itself and ``YEARS_BACK``
    years, however long the history, and its plan does not hold those of earlier years.
    A year is predicted in one go, so the few days whose 364- or 365-day lag falls inside the same year see NULL.
    """
    spark = state.sparkSession
    folder = folder or f"{shared_folder(spark)}/recursion-{uuid.uuid4().hex}"
    write_years(state, f"{folder}/state", keys)
    blocks = year_blocks(start, end)
    made = T.StructType([*(state.schema[k] for k in keys), state.schema["ds"], T.StructField("structural_pred", T.DoubleType()), T.StructField("residual", T.DoubleType())])
    for i, (lo, hi) in enumerate(blocks):
        rows = read_years(spark, f"{folder}/state", state.schema, lo.year - YEARS_BACK, lo.year)
        if i:
            known = read_years(spark, f"{folder}/predicted", made, lo.year - YEARS_BACK, lo.year - 1)
            rows = patch_update(rows, known, [*keys, "ds"], ["residual"])
        feats = future_safe_features(rows, keys, keep=("structural_pred",)).where(F.col("ds").between(lo, hi))
        block = learner(feats).select(*keys, "ds", F.col("structural_pred").cast("double"), F.col("residual_pred").cast("double").alias("residual"))
        write_years(block, f"{folder}/predicted", keys)
    out = read_years(spark, f"{folder}/predicted", made, blocks[0][0].year, blocks[-1][0].year)
    return out.withColumn("forecast", F.col("structural_pred") + F.col("residual"))


def missing_cells(features: DataFrame, columns, keys=KEYS) -> DataFrame:
    """NULL feature cells per series and year: the known gaps at block ends show here."""
    blank = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return features.groupBy(*keys, F.year("ds").alias("year")).agg(F.sum(blank).alias("missing_cells"))
