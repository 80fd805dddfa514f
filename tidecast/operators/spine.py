"""Date spines, gap filling, resampling.

Physical layout: a panel is hash-partitioned by its series keys once. Every window below is partitioned by those
keys (or by more columns, which that layout already satisfies), so a whole chain of them plans one exchange.
A series holds at most one row per calendar day, so no window partition outgrows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.functions.calendar import day_number, month_start
from tidecast.functions.scalars import ratio

KEYS = ("series_id",)


def by_day(keys=KEYS, ds: str = "ds"):
    """The row order of a panel; the bare date column lets consecutive windows share their sort."""
    return W.partitionBy(*keys).orderBy(ds)


def by_calendar(keys=KEYS, ds: str = "ds"):
    """The same order as a number, for RANGE frames that count calendar days."""
    return W.partitionBy(*keys).orderBy(day_number(F.col(ds)))


def by_day_backwards(keys=KEYS, ds: str = "ds"):
    return W.partitionBy(*keys).orderBy(F.col(ds).desc())


def _bound(value, fallback: Column) -> Column:
    return fallback if value is None else F.to_date(F.lit(str(value)))


def date_spine(df: DataFrame, keys=KEYS, start=None, end=None, ds: str = "ds") -> DataFrame:
    """Every day from first to last (or to the given bounds) of each series; none for a series that begins after ``end``."""
    bounds = df.groupBy(*keys).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    first, last = _bound(start, F.col("_lo")), _bound(end, F.col("_hi"))
    days = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return bounds.select(*keys, F.explode(days).alias(ds))


def densify(df: DataFrame, spine: DataFrame, keys=KEYS, ds: str = "ds") -> DataFrame:
    """Reindex onto a spine; days without a row become NULL."""
    return spine.join(df, [*keys, ds], "left")


def fill_gaps(df: DataFrame, keys=KEYS, ds: str = "ds") -> DataFrame:
    """Insert the missing days between first and last row of each series, values NULL.

    Same result as ``densify`` on the series' own spine, but each row emits the gap behind it: one window and an
    explode in place of an aggregate and a join. Two rows of a series on one day are an error; sum them first (``daily_total``).
    """
    values = [c for c in df.columns if c not in (*keys, ds)]
    following = F.lead(ds).over(by_day(keys, ds))
    twice = F.raise_error(F.concat(F.lit("two rows of a series on "), F.col(ds).cast("string")))
    until = F.when(following == F.col(ds), twice).otherwise(F.coalesce(F.date_sub(following, 1), F.col(ds)))
    run = df.withColumn("_until", until).select(
        *keys, F.col(ds).alias("_from"), *values, F.explode(F.sequence(ds, "_until")).alias(ds))
    first = F.col(ds) == F.col("_from")
    return run.select(*keys, ds, *[F.when(first, F.col(v)).alias(v) for v in values])


def interpolate_time(df: DataFrame, columns, keys=KEYS, ds: str = "ds") -> DataFrame:
    """Linear interpolation by elapsed days. Leading NULLs stay; trailing ones repeat the last value."""
    before = by_day(keys, ds).rowsBetween(W.unboundedPreceding, 0)
    after = by_day_backwards(keys, ds).rowsBetween(W.unboundedPreceding, 0)
    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(ds).alias("d"), F.col(c).alias("v")))

    out = df.select("*", *[F.last(known(c), ignorenulls=True).over(before).alias(f"_p_{c}") for c in columns])
    out = out.select("*", *[F.last(known(c), ignorenulls=True).over(after).alias(f"_n_{c}") for c in columns])
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        span, gone = F.datediff(n["d"], p["d"]), F.datediff(F.col(ds), p["d"])
        between = p["v"] + ratio((n["v"] - p["v"]) * gone, span)
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(n.isNull(), p["v"]).otherwise(between)))
    return out.drop(*[f"_{s}_{c}" for s in "pn" for c in columns])


def complete_years(df: DataFrame, keys=KEYS, min_days: int = 360, ds: str = "ds") -> DataFrame:
    """Keep the calendar years that have at least ``min_days`` rows."""
    size = F.count("*").over(W.partitionBy(*keys, F.year(ds)))
    return df.withColumn("_n", size).where(F.col("_n") >= min_days).drop("_n")


def load_panel(daily: DataFrame, columns=("revenue", "cogs"), keys=KEYS, min_days: int = 360) -> DataFrame:
    """Daily rows -> gap-free, interpolated panel of complete years, in one exchange."""
    laid_out = daily.repartition(*keys)
    return complete_years(interpolate_time(fill_gaps(laid_out, keys), columns, keys), keys, min_days)


def monthly_to_daily(monthly: DataFrame, spine: DataFrame, columns, snap: str = "snap", keys=(), ds: str = "ds",
                     fill_last_month: bool = False) -> DataFrame:
    """Carry a monthly snapshot through its month.

    Daily forward fill of month-start snapshots ends on the last snapshot day, so later days of that month are
    NULL; ``fill_last_month=True`` deviates and fills them. A month without a snapshot repeats the previous one,
    as a forward fill does: each snapshot emits the months up to the next.
    """
    order = W.partitionBy(*keys, F.lit(1)).orderBy(snap)  # one row per month of the calendar
    upto = F.coalesce(F.add_months(F.lead(snap).over(order), -1), F.col(snap))
    last = F.lead(snap).over(order).isNull()
    runs = monthly.select(*keys, *columns, snap, upto.alias("_upto"), last.alias("_last")).select(
        *keys, *columns, "_last", F.explode(F.expr(f"sequence({snap}, _upto, interval 1 month)")).alias("_month"))
    on = [*keys, "_month"]
    joined = spine.withColumn("_month", month_start(F.col(ds))).join(runs, on, "left")
    if not fill_last_month:
        keep = ~F.coalesce(F.col("_last"), F.lit(False)) | (F.col(ds) == F.col("_month"))
        joined = joined.select(*spine.columns, *[F.when(keep, F.col(c)).alias(c) for c in columns])
    return joined.select(*spine.columns, *columns)


def monthly_mean(df: DataFrame, columns, snap: str = "snap", keys=()) -> DataFrame:
    return df.groupBy(*keys, snap).agg(*[F.avg(c).alias(c) for c in columns])


def daily_total(df: DataFrame, measures, keys=(), ds: str = "ds") -> DataFrame:
    """Several rows a day -> one: sums."""
    return df.groupBy(*keys, ds).agg(*[F.sum(m).alias(m) for m in measures])


def daily_mean(df: DataFrame, measures, keys=(), ds: str = "ds") -> DataFrame:
    return df.groupBy(*keys, ds).agg(*[F.avg(m).alias(m) for m in measures])
