"""Demand tables derived from the supplied star schema.

Money is summed exactly in fixed point (ten-thousandths), so daily totals do not depend on task order, and rounded to
whole currency units (the currency has no minor unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidecast.fixed_values import PROMO_EVERY_YEAR, PROMO_ODD_YEARS, PROMO_TITLES
from tidecast.functions.calendar import month_start
from tidecast.sources.tables import read_parquet

ALL = "ALL"
SPLIT = {
    "train_end": "1999-12-31",
    "val_start": "2000-01-01",
    "val_end": "2000-12-31",
    "test_start": "2001-01-01",
    "test_end": "2002-07-01",
}


def exact_units(amount: Column) -> Column:
    """Sum of an amount in ten-thousandths, exact whatever the task order.

    The high and low halves are summed as BIGINT, which stays in primitive long arithmetic and leaves room for far more
    than 10^12 rows in one group, and are put together as one DECIMAL per group.
    """
    units = F.floor(amount * 10000 + 0.5)
    high = F.sum(F.shiftright(units, 20)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit(1048575).cast("bigint"))).cast("decimal(38,0)")
    return high * 1048576 + low


def exact_total(amount: Column) -> Column:
    return exact_units(amount).cast("double") / 10000


def money_total(amount: Column) -> Column:
    return F.floor((exact_units(amount) + 5000) / 10000).cast("double")


def orders_by_day(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    o = read_parquet(spark, folder, "orders")
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds"), *columns)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their order day and product.

    No broadcast hints: ``part`` and ``orders`` grow with the data. Catalyst broadcasts a side only under its
    size threshold; otherwise it sort-merges, and AQE splits a hot order or part key.
    """
    lines = read_parquet(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    parts = read_parquet(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    orders = orders_by_day(spark, folder)
    return (lines.join(parts, lines.l_partkey == parts.p_partkey)
                 .join(orders, lines.l_orderkey == orders.o_orderkey)
                 .select("ds", "l_orderkey", "l_partkey", "p_type", "p_retailprice", "l_quantity",
                         "l_extendedprice", "l_discount"))


def daily_sales(spark: SparkSession, folder: str, series: str | None = "p_type") -> DataFrame:
    """(series_id, ds, revenue, cogs), one row per series and day with sales. ``series=None`` is the whole company."""
    key = F.col(series) if series else F.lit(ALL)
    return (order_lines(spark, folder)
            .groupBy(key.alias("series_id"), "ds")
            .agg(money_total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                 money_total(1.75 * F.col("l_quantity") * F.col("p_retailprice")).alias("cogs")))


def web_traffic(spark: SparkSession, folder: str) -> DataFrame:
    """(ds, source, sessions, unique_visitors, bounce_rate, avg_session_duration_sec): several rows per day."""
    o = orders_by_day(spark, folder, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return (o.groupBy("ds", F.col("o_orderpriority").alias("source"))
             .agg(F.count("*").alias("sessions"),
                  F.countDistinct("o_custkey").alias("unique_visitors"),
                  F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("bounce_rate"),
                  (exact_total(F.col("o_totalprice")) / F.count("*") / 1000)
                  .alias("avg_session_duration_sec")))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly snapshot per SKU."""
    li = read_parquet(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date")
    returned = (F.col("l_returnflag") == "R").cast("int")
    still_open = (F.col("l_linestatus") == "O").cast("int")
    return (li.groupBy(month_start(day).alias("snap"), F.col("l_partkey").alias("product_id"))
              .agg(F.max(returned).alias("stockout_flag"),
                   F.max(still_open).alias("overstock_flag"),
                   F.avg(1 - returned).alias("fill_rate"),
                   F.sum("l_quantity").alias("days_of_supply"),
                   F.sum("l_quantity").cast("bigint").alias("units_sold"),
                   F.avg(1 - still_open).alias("sell_through_rate"))
              .withColumn("year", F.year("snap")).withColumn("month", F.month("snap")))


def promo_table(years: DataFrame, year: str = "year") -> DataFrame:
    """(family, promo_name, year, start_date, end_date) from the fixed calendar, for each given year."""
    families = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(PROMO_TITLES[f]).alias("title"), F.lit(s).alias("start"),
                 F.lit(n).alias("days"), F.lit(f in PROMO_ODD_YEARS).alias("odd_only"))
        for f, (s, n) in {**PROMO_EVERY_YEAR, **PROMO_ODD_YEARS}.items()])
    y = F.col(year)
    began = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), F.col("f.start") - 1)
    return (years.select(y.cast("int").alias(year)).distinct().select(year, F.explode(families).alias("f"))
            .where(~F.col("f.odd_only") | (F.pmod(y, F.lit(2)) == 1))
            .select("f.family", F.concat_ws(" ", "f.title", y.cast("string")).alias("promo_name"), year,
                    began.alias("start_date"), F.date_add(began, F.col("f.days") - 1).alias("end_date")))


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """Promotion intervals for every year that has orders."""
    return promo_table(orders_by_day(spark, folder).select(F.year("ds").alias("year")))
