"""Inputs shared by the plans, each derived from the supplied tables.

A daily panel is tiny beside the line items it comes from. Where a plan uses it more than once, the ``_once`` form writes
it to the shared folder first, so that the raw tables are scanned a single time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecast.operators.baselines import naive_structure, profile_forecast
from tidecast.operators.denoise import denoise_target
from tidecast.operators.evaluation import between
from tidecast.operators.features import exog_table
from tidecast.operators.spine import KEYS, daily_total, date_spine, load_panel
from tidecast.session import cut_lineage
from tidecast.sources.bindings import SPLIT, daily_sales, inventory, orders_by_day, web_traffic


def panel(spark: SparkSession, folder: str, series: str | None = "p_type") -> DataFrame:
    return load_panel(daily_sales(spark, folder, series))


def daily_once(spark, folder, series: str | None = "p_type") -> DataFrame:
    return cut_lineage(daily_sales(spark, folder, series))


def panel_once(spark, folder, series: str | None = "p_type") -> DataFrame:
    return cut_lineage(panel(spark, folder, series))


def clean_panel(spark, folder, series: str | None = "p_type") -> DataFrame:
    return denoise_target(panel(spark, folder, series))


def clean_panel_once(spark, folder, series: str | None = "p_type") -> DataFrame:
    return cut_lineage(clean_panel(spark, folder, series))


def traffic(spark, folder) -> DataFrame:
    return daily_total(web_traffic(spark, folder), ["sessions"])


def full_days(spark, folder) -> DataFrame:
    """Every day from the first order to the end of the horizon."""
    days = orders_by_day(spark, folder).select(F.lit("ALL").alias("series_id"), "ds")
    return date_spine(days, end=SPLIT["test_end"]).select("ds")


def exog(spark, folder) -> DataFrame:
    return exog_table(full_days(spark, folder), web_traffic(spark, folder), inventory(spark, folder))


def horizon(p: DataFrame) -> DataFrame:
    """(series_id, ds) over the forecast horizon."""
    return date_spine(p, start=SPLIT["test_start"], end=SPLIT["test_end"])


def profile_fc(spark, folder, p: DataFrame | None = None) -> DataFrame:
    """(series_id, ds, revenue, cogs) over the horizon from the seasonal profile."""
    p = panel_once(spark, folder) if p is None else p
    fc = profile_forecast(p, horizon(p), base_year=2000)
    return fc.select(*KEYS, "ds", F.col("revenue_pred").alias("revenue"), F.col("cogs_pred").alias("cogs"))


def naive_panel(spark, folder, p: DataFrame | None = None) -> DataFrame:
    """Panel with the same-day-last-year structure and its residual."""
    p = naive_structure(panel(spark, folder) if p is None else p)
    return p.withColumn("residual", F.col("revenue") - F.col("structural_pred"))


def naive_errors(spark, folder, p: DataFrame | None = None) -> DataFrame:
    """Validation-year errors of the same-day-last-year forecast."""
    v = between(naive_panel(spark, folder, p), SPLIT["val_start"], SPLIT["val_end"])
    e = F.col("revenue") - F.col("structural_pred")
    return v.select(*KEYS, "ds", F.col("revenue").alias("y"), F.col("structural_pred").alias("pred"), e.alias("error"),
                    F.try_divide(e, F.col("structural_pred")).alias("rel_error"))


def profile_state(spark, folder, p: DataFrame | None = None) -> DataFrame:
    """(series_id, ds, revenue, structural_pred, structural_trend, residual) over history and horizon, where the
    structure is the seasonal profile on the grown base level; model-free, so plain SQL can repeat it."""
    p = panel_once(spark, folder) if p is None else p
    days = date_spine(p, end=SPLIT["test_end"])
    s = profile_forecast(p, days, 2000, ["revenue"]).withColumnRenamed("revenue_pred", "structural_pred")
    out = s.join(p.select(*KEYS, "ds", "revenue"), [*KEYS, "ds"], "left")
    return out.withColumn("structural_trend", F.col("structural_pred")).withColumn(
        "residual", F.col("revenue") - F.col("structural_pred"))
