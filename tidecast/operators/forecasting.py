"""Cost ratio, blending, post-processing, metrics, intervals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidecast.functions.scalars import clip, cogs_ratio, ratio
from tidecast.operators.aggregates import parity_month_median
from tidecast.operators.joins import with_parity_month
from tidecast.operators.spine import KEYS
from tidecast.sources.tables import write_csv


def blend(structural: Column, residual: Column) -> Column:
    return structural + residual


def clipped_ratio(lo: float = 0.5, hi: float = 1.6) -> Column:
    return clip(cogs_ratio(F.col("revenue"), F.col("cogs")), lo, hi)


def seasonal_ratio(history: DataFrame, train_end: str, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Median cost ratio by (year parity, month) up to ``train_end``, and the overall median as default."""
    past = history.where(F.col("ds") <= F.to_date(F.lit(train_end)))
    table = parity_month_median(past, clipped_ratio(), keys)
    return table, past.groupBy(*keys).agg(F.median(clipped_ratio()).alias("ratio_default"))


def apply_ratio(forecast: DataFrame, table: DataFrame, default: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``ratio_pred``; cells missing from the table take the series' overall median."""
    keyed = with_parity_month(forecast).join(table, [*keys, "parity", "month"], "left").join(default, list(keys), "left")
    return keyed.withColumn("ratio_pred", F.coalesce("ratio", "ratio_default")).select(*forecast.columns, "ratio_pred")


def cogs_from_ratio(forecast: DataFrame, history: DataFrame, train_end: str, revenue: str = "revenue_pred",
                    keys=KEYS) -> DataFrame:
    out = apply_ratio(forecast, *seasonal_ratio(history, train_end, keys), keys)
    return out.withColumn("cogs_pred", F.col(revenue) * F.col("ratio_pred"))


def postprocess(forecast: DataFrame, columns=("revenue", "cogs"), cap_cogs: bool = False) -> DataFrame:
    """Negative values to zero and half-even rounding to two places; optionally cap cost at revenue.

    Cost above revenue is otherwise kept: it is a legitimate clearance loss and only audited.
    """
    out = forecast
    for c in columns:
        out = out.withColumn(c, F.bround(clip(F.col(c), lo=0.0), 2))
    return out.withColumn("cogs", F.least("cogs", "revenue")) if cap_cogs else out


def loss_audit(forecast: DataFrame, limit_pct: float = 20.0, keys=KEYS) -> DataFrame:
    """Days with cost above revenue, their share, and whether it is suspiciously high."""
    loss = F.col("cogs") > F.col("revenue")
    pct = F.avg(loss.cast("int")) * 100
    return forecast.groupBy(*keys).agg(
        F.count_if(loss).alias("loss_days"), F.count("*").alias("days"), pct.alias("loss_pct"),
        (pct > limit_pct).alias("suspicious"))


def submission_contract(template: DataFrame, forecast: DataFrame, keys=KEYS) -> DataFrame:
    """Template dates against forecast dates: matched, missing and extra rows per series."""
    t = template.select(*keys, "ds").withColumn("_t", F.lit(1))
    f = forecast.select(*keys, "ds").withColumn("_f", F.lit(1))
    both = t.join(f, [*keys, "ds"], "full")
    has_t, has_f = F.col("_t").isNotNull(), F.col("_f").isNotNull()
    out = both.groupBy(*keys).agg(
        F.count_if(has_t).alias("expected"), F.count_if(has_f).alias("produced"),
        F.count_if(has_t & ~has_f).alias("missing"), F.count_if(has_f & ~has_t).alias("extra"))
    return out.withColumn("matches", F.col("expected") == F.col("produced"))


def follow_template(template: DataFrame, forecast: DataFrame, keys=KEYS) -> DataFrame:
    """One row per template date, in the template's dates; NULL where nothing was predicted, other dates left out."""
    return template.select(*keys, "ds").join(forecast, [*keys, "ds"], "left")


DELIVERED = ("ds", "revenue", "cogs")


def deliver(template: DataFrame, forecast: DataFrame, path: str, keys=KEYS) -> None:
    """Write the forecast in the template's dates as CSV: keys, date, revenue, cost, in that order and sorted."""
    columns = [*keys, *DELIVERED]
    write_csv(follow_template(template, forecast, keys), path, columns, order=[*keys, "ds"])


def delivered(spark, path: str, key_type: str = "string", keys=KEYS) -> DataFrame:
    schema = ", ".join([*(f"{k} {key_type}" for k in keys), "ds DATE, revenue DOUBLE, cogs DOUBLE"])
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def prediction_interval(forecast: DataFrame, errors: DataFrame, pred: str = "forecast", error: str = "error",
                        z: float = 1.96, keys=KEYS) -> DataFrame:
    """± z·σ of the validation errors around the forecast, lower end at zero."""
    sigma = errors.groupBy(*keys).agg(F.stddev_samp(error).alias("_sigma"))
    out = forecast.join(sigma, list(keys), "left")
    return (out.withColumn("lower_95", clip(F.col(pred) - z * F.col("_sigma"), lo=0.0))
               .withColumn("upper_95", F.col(pred) + z * F.col("_sigma")).drop("_sigma"))


def metric_columns(y: Column, p: Column) -> list[Column]:
    """MAE, RMSE, R² and MAPE in one pass over the pairs where both sides are known."""
    both = y.isNotNull() & p.isNotNull()
    e = F.when(both, y - p)
    y = F.when(both, y)
    r2 = 1 - ratio(F.sum(e * e), F.count(y) * F.var_pop(y))
    return [F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"),
            (F.avg(F.abs(ratio(e, y))) * 100).alias("mape")]


def forecast_metrics(pairs: DataFrame, y: str = "y", pred: str = "pred", by=("model", "target")) -> DataFrame:
    return pairs.groupBy(*by).agg(*metric_columns(F.col(y), F.col(pred)))


def drift_ratio(proxy: DataFrame, baseline: DataFrame, residual: str = "residual", keys=KEYS) -> DataFrame:
    """Mean absolute proxy residual per forecast year over that of the last actual year."""
    base = baseline.groupBy(*keys).agg(F.avg(F.abs(residual)).alias("baseline_mae"))
    yearly = proxy.groupBy(*keys, F.year("ds").alias("year")).agg(F.avg(F.abs(residual)).alias("proxy_mae"))
    return yearly.join(base, list(keys), "left").withColumn(
        "drift", ratio(F.col("proxy_mae"), F.col("baseline_mae")))


def split_check(panel: DataFrame, train_end: str, val_start: str, val_end: str, min_train: int = 365,
                keys=KEYS) -> DataFrame:
    """Is the split out of sample, with how large a gap, and is there enough training history?"""
    t, vs, ve = (date.fromisoformat(d) for d in (train_end, val_start, val_end))
    in_train = F.col("ds") <= F.lit(t)
    return panel.groupBy(*keys).agg(
        F.lit(vs > t).alias("out_of_sample"), F.lit((vs - t).days).alias("gap_days"),
        F.count_if(in_train).alias("train_days"), F.lit((ve - vs).days + 1).alias("val_days"),
        (F.count_if(in_train) >= min_train).alias("enough_history"))
