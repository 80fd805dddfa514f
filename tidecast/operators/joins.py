"""Join recipes. Size decides the join: Catalyst and AQE broadcast below their threshold and sort-merge above it.

Only tables with at most one row per calendar day (or month, or parity × month) carry a broadcast hint, because
the calendar bounds them whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.functions.calendar import parity
from tidecast.operators.spine import KEYS


def align(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Common rows without missing values: an outer align followed by a NULL drop is an inner join on non-NULL rows."""
    return a.dropna().join(b.dropna(), on, "inner")


def align_left(base: DataFrame, other: DataFrame, on) -> DataFrame:
    return base.join(other, on, "left")


def index_intersect(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b.select(*on), on, "left_semi")


def patch_update(base: DataFrame, new: DataFrame, on, columns) -> DataFrame:
    """Overwrite with the non-NULL values of ``new``; keep the old value elsewhere."""
    fresh = new.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(fresh, on, "left")
    keep = [F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*keep)


def lookup_default(df: DataFrame, table: DataFrame, on, value: str, default: Column) -> DataFrame:
    return df.join(table, on, "left").withColumn(value, F.coalesce(F.col(value), default))


def interval_days(promos: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Closed intervals -> the distinct days they cover, so a range join becomes an equi join."""
    return promos.select(F.explode(F.sequence(start, end)).alias("ds")).distinct()


def interval_flag(df: DataFrame, promos: DataFrame, name: str = "is_promo") -> DataFrame:
    """1 on days inside any interval. The covered days are one row per calendar day: bounded, so broadcast."""
    days = interval_days(promos).withColumn(name, F.lit(1))
    return df.join(F.broadcast(days), "ds", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def event_window(series: DataFrame, events: DataFrame, before: int = 7, after: int = 14, event: str = "event",
                 start: str = "start_date", require_ends: bool = True, keys=KEYS) -> DataFrame:
    """Rows from −before to +after days around each event start; events cut by either end of the series drop out."""
    offsets = F.sequence(F.lit(-before), F.lit(after))
    days = events.select(F.col(event), F.col(start), F.explode(offsets).alias("offset"))
    days = days.withColumn("ds", F.expr(f"date_add({start}, offset)"))
    joined = series.join(days, "ds")
    if not require_ends:
        return joined
    whole = W.partitionBy(*keys, event, start)
    return (joined.withColumn("_lo", F.min("offset").over(whole)).withColumn("_hi", F.max("offset").over(whole))
            .where((F.col("_lo") == -before) & (F.col("_hi") == after)).drop("_lo", "_hi"))


def mark_recurring(df: DataFrame, qualifying: DataFrame, name: str = "is_recurring", keys=KEYS) -> DataFrame:
    """Flag rows whose (month, day) is in the qualifying set of their series."""
    marks = qualifying.select(*keys, F.col("month").alias("_m"), F.col("day").alias("_d"), F.lit(True).alias(name))
    out = df.withColumn("_m", F.month("ds")).withColumn("_d", F.dayofmonth("ds"))
    return (out.join(marks, [*keys, "_m", "_d"], "left")
               .withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop("_m", "_d"))


def with_parity_month(df: DataFrame) -> DataFrame:
    return df.withColumn("parity", parity(F.col("ds"))).withColumn("month", F.month("ds"))
