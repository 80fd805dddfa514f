"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidecast.functions.calendar import parity
from tidecast.functions.scalars import ratio, strip_year
from tidecast.operators.ranks import histogram_quantiles, running_share
from tidecast.operators.spine import KEYS
from tidecast.session import cut_lineage


def resample(df: DataFrame, unit: str, columns, keys=KEYS, ds: str = "ds") -> DataFrame:
    """Mean, sample deviation and sum per calendar unit (``month``, ``quarter``, ``year``)."""
    period = F.date_trunc(unit, F.col(ds)).cast("date").alias("period")
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.sum(c).alias(f"{c}_sum")]
    return df.groupBy(*keys, period).agg(*aggs)


def pivot_months(df: DataFrame, value: Column, fn, keys=KEYS, ds: str = "ds", prefix: str = "M") -> DataFrame:
    """Year × month table with columns M01…M12. The month list is given, so no extra job looks it up."""
    out = (df.select(*keys, F.year(ds).alias("year"), F.month(ds).alias("_month"), value.alias("_v"))
             .groupBy(*keys, "year").pivot("_month", list(range(1, 13))).agg(fn("_v")))
    return out.select(*keys, "year", *[F.col(str(m)).alias(f"{prefix}{m:02d}") for m in range(1, 13)])


def pivot_categories(df: DataFrame, category: str, value: str, ds: str = "ds", most: int = 500) -> DataFrame:
    """Year × category totals, one column per category found in the data (lower case), zero where a year has none.

    More than ``most`` categories are an error: a table that wide belongs in long form (``category_years``).
    """
    totals = cut_lineage(df.groupBy(F.year(ds).alias("year"), F.col(category).alias("_c")).agg(F.sum(value).alias("_v")))
    names = [r["_c"] for r in totals.where(F.col("_c").isNotNull()).select("_c").distinct().orderBy("_c").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} categories: use category_years")
    wide = totals.groupBy("year").pivot("_c", names).agg(F.sum("_v")).na.fill(0)
    return wide.select("year", *[F.col(f"`{n}`").alias(n.lower()) for n in names])


def category_years(df: DataFrame, category: str, value: str, ds: str = "ds") -> DataFrame:
    """(year, category, total) for every category in every year that has any row, zero where it has none."""
    totals = df.groupBy(F.year(ds).alias("year"), category).agg(F.sum(value).alias(value))
    years = df.select(F.year(ds).alias("year")).distinct()
    # one array with an entry per calendar year, for each category
    spans = df.select(category).distinct().crossJoin(F.broadcast(years.agg(F.collect_set("year").alias("_years"))))
    return (spans.select(category, F.explode("_years").alias("year")).join(totals, ["year", category], "left")
            .select("year", category, F.coalesce(value, F.lit(0)).alias(value)))


def range_ratio(stats: DataFrame, wide: str, narrow: str) -> DataFrame:
    """(range_ratio, wider): range of one flag's monthly shares over that of another (see ``flag_share_stats``); NULL where the other never varies."""
    span = lambda flag: F.max(F.when(F.col("flag") == flag, F.col("max_share") - F.col("min_share")))
    return stats.agg(span(wide).alias("_a"), span(narrow).alias("_b")).select(ratio(F.col("_a"), F.col("_b")).alias("range_ratio"), (F.col("_a") > F.col("_b")).alias("wider"))


def share_cumulative(totals: DataFrame, label: str, value: str, keys=()) -> DataFrame:
    """Share and running share in descending order, on already aggregated rows (one per label); any number of labels."""
    down = running_share(totals.select(*keys, label, value), label, value, keys)
    return down.select(*keys, label, value, (ratio(F.col(value), F.col("_total")) * 100).alias("share_pct"),
                       (ratio(F.col("_running"), F.col("_total")) * 100).alias("cum_pct"))


def argmax_row(df: DataFrame, value: str, order: str, keys=KEYS) -> DataFrame:
    """Row position of the maximum, the smallest on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("k"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, (-F.col("_b.k")).alias(order), F.col("_b.v").alias(value))


def family_stats(promos: DataFrame, name: str = "promo_name", start: str = "start_date") -> DataFrame:
    """Per promotion family: range of start days, number of years, and whether it runs in odd years only."""
    year, doy = F.year(start), F.dayofyear(start)
    odd = F.bool_and(F.pmod(year, F.lit(2)) == 1)
    n_years = F.countDistinct(year)
    return (promos.groupBy(strip_year(F.col(name)).alias("family"))
            .agg(F.min(doy).alias("doy_min"), F.max(doy).alias("doy_max"), (F.max(doy) - F.min(doy)).alias("spread"),
                 n_years.alias("n_years"), (odd & (n_years > 1)).alias("biennial")))


def flag_share_stats(snapshots: DataFrame, flags, snap: str = "snap") -> DataFrame:
    """Monthly share of each 0/1 flag, then its spread over the months: shows flags that never vary."""
    cells = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("double").alias("x")) for f in flags])
    monthly = (snapshots.groupBy(snap).agg(*[F.avg(f).alias(f) for f in flags])
               .select(F.explode(cells).alias("_c")).select("_c.flag", "_c.x"))
    return monthly.groupBy("flag").agg(
        F.min("x").alias("min_share"), F.median("x").alias("median_share"), F.max("x").alias("max_share"),
        F.var_samp("x").alias("variance"), F.count_if(F.col("x") > 0.5).alias("months_above_half"),
        F.count("*").alias("months"))


def describe(df: DataFrame, columns, keys=()) -> DataFrame:
    """Count, mean, deviation, quartiles and range per column, long form, for groups of any size."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").where(F.col("value").isNotNull())
    group = [*keys, "column"]
    basic = long.groupBy(*group).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    counts = long.groupBy(*group, "value").agg(F.count("*").alias("n"))
    return basic.join(histogram_quantiles(counts, group, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), group).select(
        *group, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def kpi_totals(df: DataFrame, keys=()) -> DataFrame:
    revenue, cogs = F.sum("revenue"), F.sum("cogs")
    return df.groupBy(*keys).agg(
        revenue.alias("revenue"), cogs.alias("cogs"), (revenue - cogs).alias("profit"),
        (ratio(revenue - cogs, revenue) * 100).alias("margin_pct"), F.avg("revenue").alias("revenue_per_day"))


def parity_month_median(df: DataFrame, value: Column, keys=KEYS, ds: str = "ds") -> DataFrame:
    """Exact median per (year parity, month). A group holds a month's days of every other year, so it is small."""
    return df.groupBy(*keys, parity(F.col(ds)).alias("parity"), F.month(ds).alias("month")).agg(
        F.median(value).alias("ratio"))
