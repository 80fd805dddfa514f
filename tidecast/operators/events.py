"""Event calendar: long form, 0/1 matrix, and the event study around promotion starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidecast.fixed_values import EVENTS
from tidecast.functions.calendar import event_columns, event_flag
from tidecast.functions.scalars import ratio
from tidecast.operators.joins import event_window
from tidecast.operators.spine import KEYS


def event_calendar(days: DataFrame, events=EVENTS, first_year: int = 0, last_year: int | None = None) -> DataFrame:
    """(event, ds) rows for a table of days. Membership is computed from the date, so nothing is joined."""
    hits = F.array_compact(F.array(*[
        F.when(event_flag(F.col("ds"), e, first_year, last_year), F.lit(e)) for e in events]))
    return days.select("ds", F.explode(hits).alias("event")).select("event", "ds")


def event_matrix(days: DataFrame, events=EVENTS, first_year: int = 0, last_year: int | None = None) -> DataFrame:
    """The same calendar as 0/1 columns next to the day; a narrow projection."""
    return days.select("*", *event_columns(F.col("ds"), events, first_year, last_year))


def event_lift(series: DataFrame, promos: DataFrame, col: str = "revenue", event: str = "promo_name",
               before: int = 7, after: int = 14, keys=KEYS) -> DataFrame:
    """Lift % of each day around each start against the mean of the days up to and including the start."""
    rows = event_window(series.select(*keys, "ds", col), promos, before, after, event=event, keys=keys)
    base = F.avg(F.when(F.col("offset") <= 0, F.col(col))).over(W.partitionBy(*keys, event, "start_date"))
    return rows.withColumn("lift_pct", (ratio(F.col(col), base) - 1) * 100)


def event_study(lift: DataFrame, keys=KEYS) -> DataFrame:
    """Mean, median and quartiles of the lift per offset; one value per promotion and offset."""
    q = F.percentile("lift_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = lift.groupBy(*keys, "offset").agg(
        F.avg("lift_pct").alias("mean_lift"), q.alias("_q"), F.count("*").alias("n_events"))
    return out.select(*keys, "offset", "mean_lift", F.col("_q")[1].alias("median_lift"), F.col("_q")[0].alias("q25"),
                      F.col("_q")[2].alias("q75"), "n_events")
