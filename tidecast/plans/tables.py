"""Scans, spines, projections, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecast.functions import calendar as cal, scalars as sc
from tidecast.operators import joins as jn, spine as sp, windows as wn
from tidecast.operators.evaluation import between
from tidecast.operators.forecasting import apply_ratio, seasonal_ratio, submission_contract
from tidecast.operators.baselines import seasonal_profile
from tidecast.plans import inputs as src
from tidecast.plans.registry import query, settled as R
from tidecast.session import cut_lineage, shared_folder
from tidecast.sources.bindings import (SPLIT, daily_sales, exact_total, inventory, order_lines, orders_by_day, promotions, web_traffic)
from tidecast.sources.tables import read_csv, read_parquet, scan_csv, write_csv

KEYS = ["series_id"]


# --- scans and sinks ---------------------------------------------------------------------------

@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_table(spark, sf):
    return read_parquet(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("scan_dates", "SELECT ds, count(*) AS n_orders, min(o_orderkey) AS first_order FROM x_orders GROUP BY 1")
def scan_dates(spark, sf):
    """Dates by cast, over all orders."""
    o = read_parquet(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderdate").cast("date").alias("ds"))
             .agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_order")))


ORDER_LINES = """CASE WHEN o_orderkey % 40 = 11 THEN strftime(ds, '%d/%m/%Y') WHEN o_orderkey % 40 = 23 THEN 'unknown' ELSE CAST(ds AS VARCHAR) END"""


def _order_csv(spark, sf):
    """The orders as a CSV folder in which some dates are in another format or no dates at all."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    o = read_parquet(spark, sf, "orders").withColumn("ds", F.to_date("o_orderdate"))
    k = F.pmod("o_orderkey", F.lit(40))
    text = F.when(k == 11, F.date_format("ds", "dd/MM/yyyy")).when(k == 23, "unknown").otherwise(F.col("ds").cast("string"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("order_id"), text.alias("order_date"), F.col("o_orderpriority").alias("payment_method"),
                    F.col("o_orderstatus").alias("device_type"), F.lit("web").alias("order_source"))
    write_csv(rows, path, rows.columns, order=())
    return path


@query("scan_csv_dates", """SELECT ds, count(*) AS n_orders FROM x_orders WHERE o_orderkey % 40 NOT IN (11, 23) GROUP BY 1""")
def scan_csv_dates(spark, sf):
    """Dates parsed from the CSV form of all orders; lines with another date format are set aside, not turned into NULL."""
    good, _ = scan_csv(spark, _order_csv(spark, sf), "orders")
    return good.groupBy(F.col("order_date").alias("ds")).agg(F.count("*").alias("n_orders"))


@query("scan_csv_rejects", f"""SELECT o_orderkey || ',' || {ORDER_LINES} || ',' || o_orderpriority || ',' || o_orderstatus || ',web' AS line FROM x_orders WHERE o_orderkey % 40 IN (11, 23)""")
def scan_csv_rejects(spark, sf):
    """The lines that do not parse, as they stand in the file."""
    return scan_csv(spark, _order_csv(spark, sf), "orders")[1]


@query("sink_csv", """SELECT ds, revenue, cogs FROM x_sales_all""")
def sink_csv(spark, sf):
    """Daily sales written as CSV and read back with the declared schema."""
    path = f"{shared_folder(spark)}/sales-{uuid.uuid4().hex}"
    daily = daily_sales(spark, sf, None).select(
        F.col("ds").alias("Date"), F.col("revenue").alias("Revenue"), F.col("cogs").alias("COGS"))
    write_csv(daily, path, ["Date", "Revenue", "COGS"], order=["Date"])
    back = read_csv(spark, path, "sales")
    return back.select(F.col("Date").alias("ds"), F.col("Revenue").alias("revenue"), F.col("COGS").alias("cogs"))


@query("submission_contract", """WITH t AS (SELECT s.series_id, h.ds FROM (SELECT DISTINCT series_id FROM x_panel) s, x_horizon h),
    f AS (SELECT series_id, ds FROM x_sales WHERE ds >= DATE '2001-01-01')
    SELECT series_id, count(t_ds) AS expected, count(f_ds) AS produced,
    count(CASE WHEN f_ds IS NULL THEN 1 END) AS missing, count(CASE WHEN t_ds IS NULL THEN 1 END) AS extra,
    count(t_ds) = count(f_ds) AS matches
    FROM (SELECT coalesce(t.series_id, f.series_id) AS series_id, t.ds AS t_ds, f.ds AS f_ds
          FROM t FULL JOIN f ON t.series_id = f.series_id AND t.ds = f.ds) GROUP BY 1""")
def submission_contract_q(spark, sf):
    """Horizon template against the days that really have sales."""
    daily = src.daily_once(spark, sf)
    produced = daily.where(F.col("ds") >= F.to_date(F.lit("2001-01-01")))
    return submission_contract(src.horizon(sp.load_panel(daily)), produced)


# --- spines ------------------------------------------------------------------------------------

@query("date_spine", "SELECT series_id, ds FROM x_spine")
def date_spine(spark, sf):
    return sp.date_spine(daily_sales(spark, sf))


@query("densify", "SELECT series_id, ds, revenue, cogs FROM x_dense")
def densify(spark, sf):
    """Reindexed onto the series' own spine; ``interpolate_time`` below runs the one-exchange form."""
    daily = src.daily_once(spark, sf)
    return sp.densify(daily, sp.date_spine(daily))


@query("interpolate_time", f"SELECT series_id, ds, {R('revenue', 3)} AS revenue, {R('cogs', 3)} AS cogs FROM x_filled")
def interpolate_time(spark, sf):
    dense = sp.fill_gaps(daily_sales(spark, sf).repartition("series_id"))
    out = sp.interpolate_time(dense, ["revenue", "cogs"])
    return out.select("series_id", "ds", sc.settle(F.col("revenue"), 3).alias("revenue"),
                      sc.settle(F.col("cogs"), 3).alias("cogs"))


@query("complete_years", f"SELECT series_id, ds, {R('revenue', 3)} AS revenue, {R('cogs', 3)} AS cogs FROM x_panel")
def complete_years(spark, sf):
    return src.panel(spark, sf).select("series_id", "ds", sc.settle(F.col("revenue"), 3).alias("revenue"),
                                       sc.settle(F.col("cogs"), 3).alias("cogs"))


@query("month_key", """SELECT make_date(year(snap), month(snap), 1) AS month_start, count(*) AS skus,
    CAST(sum(units_sold) AS BIGINT) AS units_sold FROM x_inv GROUP BY 1""")
def month_key(spark, sf):
    inv = inventory(spark, sf)
    return (inv.groupBy(cal.month_key(F.col("year"), F.col("month")).alias("month_start"))
               .agg(F.count("*").alias("skus"), F.sum("units_sold").alias("units_sold")))


@query("monthly_to_daily", f"""SELECT ds, {R('overstock_pct', 6)} AS overstock_pct, {R('days_of_supply', 4)} AS days_of_supply,
    {R('fill_rate', 6)} AS fill_rate FROM x_exog""")
def monthly_to_daily(spark, sf):
    monthly = sp.monthly_mean(inventory(spark, sf).withColumnRenamed("overstock_flag", "overstock_pct"),
                              ["overstock_pct", "days_of_supply", "fill_rate"])
    out = sp.monthly_to_daily(monthly, src.full_days(spark, sf),
                              ["overstock_pct", "days_of_supply", "fill_rate"])
    return out.select("ds", sc.settle(F.col("overstock_pct"), 6).alias("overstock_pct"),
                      sc.settle(F.col("days_of_supply"), 4).alias("days_of_supply"),
                      sc.settle(F.col("fill_rate"), 6).alias("fill_rate"))


@query("inventory_flags_daily", """SELECT d.ds, CASE WHEN d.ds <= z.top THEN m.stockout_any END AS stockout_flag
    FROM x_full_days d ASOF LEFT JOIN x_month m ON d.ds >= m.snap CROSS JOIN (SELECT max(snap) AS top FROM x_month) z""")
def inventory_flags_daily(spark, sf):
    monthly = inventory(spark, sf).groupBy("snap").agg(F.max("stockout_flag").alias("stockout_flag"))
    return sp.monthly_to_daily(monthly, src.full_days(spark, sf), ["stockout_flag"])


@query("daily_traffic", """SELECT ds, CAST(sum(sessions) AS BIGINT) AS sessions,
    CAST(sum(unique_visitors) AS BIGINT) AS unique_visitors FROM x_traffic_src GROUP BY 1""")
def daily_traffic(spark, sf):
    return sp.daily_total(web_traffic(spark, sf), ["sessions", "unique_visitors"])


@query("daily_traffic_means", f"""SELECT ds, {R('avg(bounce_rate)', 6)} AS bounce_rate,
    {R('avg(avg_session_duration_sec)', 4)} AS avg_session_duration_sec FROM x_traffic_src GROUP BY 1""")
def daily_traffic_means(spark, sf):
    out = sp.daily_mean(web_traffic(spark, sf), ["bounce_rate", "avg_session_duration_sec"])
    return out.select("ds", sc.settle(F.col("bounce_rate"), 6).alias("bounce_rate"),
                      sc.settle(F.col("avg_session_duration_sec"), 4).alias("avg_session_duration_sec"))


@query("resample_month", f"""SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS period,
    {R('avg(revenue)', 2)} AS revenue_mean, {R('stddev_samp(revenue)', 2)} AS revenue_std,
    {R('sum(revenue)', 1)} AS revenue_sum FROM x_panel GROUP BY 1, 2""")
def resample_month(spark, sf):
    from tidecast.operators.aggregates import resample
    out = resample(src.panel(spark, sf), "month", ["revenue"])
    return out.select("series_id", "period", sc.settle(F.col("revenue_mean"), 2).alias("revenue_mean"),
                      sc.settle(F.col("revenue_std"), 2).alias("revenue_std"),
                      sc.settle(F.col("revenue_sum"), 1).alias("revenue_sum"))


@query("resample_quarter", f"""SELECT series_id, year(ds) || 'Q' || quarter(ds) AS quarter, strftime(ds, '%Y-%m') AS month,
    {R('sum(revenue)', 1)} AS revenue, {R('sum(cogs)', 1)} AS cogs FROM x_panel GROUP BY 1, 2, 3""")
def resample_quarter(spark, sf):
    ds = F.col("ds")
    return (src.panel(spark, sf)
            .groupBy("series_id", cal.quarter_label(ds).alias("quarter"), cal.month_label(ds).alias("month"))
            .agg(sc.settle(F.sum("revenue"), 1).alias("revenue"), sc.settle(F.sum("cogs"), 1).alias("cogs")))


# --- projections and predicates ----------------------------------------------------------------

@query("margin_ratio", f"""SELECT series_id, ds, {R('(revenue - cogs) / nullif(revenue, 0) * 100', 4)} AS margin_pct,
    {R('cogs / nullif(revenue, 0)', 6)} AS ratio, {R('1 - cogs / nullif(revenue, 0)', 6)} AS margin,
    revenue - cogs AS profit FROM x_sales""")
def margin_ratio(spark, sf):
    r, c = F.col("revenue"), F.col("cogs")
    return daily_sales(spark, sf).select(
        "series_id", "ds", sc.settle(sc.margin_pct(r, c), 4).alias("margin_pct"),
        sc.settle(sc.cogs_ratio(r, c), 6).alias("ratio"), sc.settle(1 - sc.cogs_ratio(r, c), 6).alias("margin"),
        (r - c).alias("profit"))


@query("line_amounts", f"""SELECT p_type AS category, count(*) AS n_lines,
    CAST(sum(CAST(l_quantity * p_retailprice - l_discount * 100 AS DECIMAL(18,4))) AS DOUBLE) AS line_revenue,
    CAST(sum(CAST(l_quantity * 1.75 * p_retailprice AS DECIMAL(18,4))) AS DOUBLE) AS line_cogs FROM x_lines GROUP BY 1""")
def line_amounts(spark, sf):
    """quantity × unit price − discount amount, and quantity × unit cost, per line; summed so the result is small."""
    lines = order_lines(spark, sf).select(
        F.col("p_type").alias("category"),
        sc.line_revenue(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_discount") * 100).alias("revenue"),
        (F.col("l_quantity") * 1.75 * F.col("p_retailprice")).alias("cogs"))
    return lines.groupBy("category").agg(
        F.count("*").alias("n_lines"), exact_total(F.col("revenue")).alias("line_revenue"),
        exact_total(F.col("cogs")).alias("line_cogs"))


@query("clip_range", f"""SELECT series_id, ds, {R('least(greatest(cogs / revenue, 0.5), 1.6)', 6)} AS ratio_clipped,
    greatest(revenue - cogs, 0.0) AS profit_floor, CAST(least(abs(dayofyear(ds) - 77), 60) AS INTEGER) AS gap_capped
    FROM x_sales WHERE revenue <> 0""")
def clip_range(spark, sf):
    r, c = F.col("revenue"), F.col("cogs")
    return daily_sales(spark, sf).where(r != 0).select(
        "series_id", "ds", sc.settle(sc.clip(sc.cogs_ratio(r, c), 0.5, 1.6), 6).alias("ratio_clipped"),
        sc.clip(r - c, lo=0.0).alias("profit_floor"),
        sc.clip(F.abs(F.dayofyear("ds") - 77), hi=60).alias("gap_capped"))


@query("clip_to_column", "SELECT series_id, ds, revenue, least(cogs, revenue) AS cogs FROM x_sales")
def clip_to_column(spark, sf):
    return daily_sales(spark, sf).select(
        "series_id", "ds", "revenue", sc.cap_by(F.col("cogs"), F.col("revenue")).alias("cogs"))


@query("date_slice", """SELECT ds, count(*) AS n_orders, CASE WHEN ds <= DATE '1999-12-31' THEN 'train' ELSE 'val' END AS part
    FROM x_orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 3""")
def date_slice(spark, sf):
    """Closed train and validation ranges; the outer bounds are pushed to the scan."""
    o = read_parquet(spark, sf, "orders").where(
        (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")))
    ds = F.col("o_orderdate").cast("date")
    part = F.when(ds <= F.to_date(F.lit(SPLIT["train_end"])), "train").otherwise("val")
    return o.groupBy(ds.alias("ds"), part.alias("part")).agg(F.count("*").alias("n_orders")).select("ds", "n_orders", "part")


@query("mask_assign", "SELECT series_id, ds, CASE WHEN cogs > revenue THEN revenue ELSE cogs END AS cogs FROM x_sales")
def mask_assign(spark, sf):
    return daily_sales(spark, sf).select(
        "series_id", "ds", F.when(F.col("cogs") > F.col("revenue"), F.col("revenue")).otherwise(F.col("cogs")).alias("cogs"))


@query("drop_nulls", f"""SELECT series_id, ds, {R('residual', 3)} AS residual FROM x_naive
    WHERE residual IS NOT NULL AND structural_trend IS NOT NULL""")
def drop_nulls(spark, sf):
    out = src.naive_panel(spark, sf).dropna(subset=["residual", "structural_trend"])
    return out.select("series_id", "ds", sc.settle(F.col("residual"), 3).alias("residual"))


@query("membership", """SELECT s.series_id, s.ds, s.revenue FROM x_sales s WHERE year(s.ds) IN (
    SELECT year(ds) FROM x_spine_all GROUP BY 1 HAVING count(*) >= 360) AND s.series_id LIKE 'S%'""")
def membership(spark, sf):
    """Years that qualify (semi join) and a name prefix."""
    daily = src.daily_once(spark, sf)
    days = sp.date_spine(daily.select(F.lit("ALL").alias("series_id"), "ds"))
    valid = days.groupBy(F.year("ds").alias("_y")).agg(F.count("*").alias("n")).where(F.col("n") >= 360).select("_y")
    s = daily.where(F.col("series_id").startswith("S")).withColumn("_y", F.year("ds"))
    return s.join(valid, "_y", "left_semi").select("series_id", "ds", "revenue")


@query("sales_over_cogs_flag", "SELECT series_id, ds, cogs > revenue AS is_loss FROM x_sales")
def sales_over_cogs_flag(spark, sf):
    return daily_sales(spark, sf).select("series_id", "ds", (F.col("cogs") > F.col("revenue")).alias("is_loss"))


@query("rename_round_format", """SELECT series_id, strftime(ds, '%Y-%m-%d') AS "Date", round_even(revenue / 7, 2) AS "Revenue",
    round_even(cogs / 7, 2) AS "COGS" FROM x_sales""")
def rename_round_format(spark, sf):
    return daily_sales(spark, sf).select(
        "series_id", F.date_format("ds", "yyyy-MM-dd").alias("Date"), F.bround(F.col("revenue") / 7, 2).alias("Revenue"),
        F.bround(F.col("cogs") / 7, 2).alias("COGS"))


# --- joins -------------------------------------------------------------------------------------

@query("join_items_orders", """SELECT ds, CAST(sum(l_quantity) AS DOUBLE) AS total_qty, count(*) AS n_lines
    FROM lineitem JOIN x_orders ON l_orderkey = o_orderkey GROUP BY 1""")
def join_items_orders(spark, sf):
    li = read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    o = orders_by_day(spark, sf)
    return (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("ds")
              .agg(F.sum("l_quantity").alias("total_qty"), F.count("*").alias("n_lines")))


@query("join_items_products_orders", """SELECT CAST(year(ds) AS INTEGER) AS year, p_type AS category, count(*) AS n_lines,
    CAST(sum(l_quantity) AS DOUBLE) AS qty FROM x_lines GROUP BY 1, 2""")
def join_items_products_orders(spark, sf):
    return (order_lines(spark, sf).groupBy(F.year("ds").alias("year"), F.col("p_type").alias("category"))
            .agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty")))


@query("join_orders_payments", """SELECT o_orderpriority, count(*) AS n_orders,
    CAST(sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) AS payment_value FROM orders JOIN (
    SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS paid FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    GROUP BY 1""")
def join_orders_payments(spark, sf):
    """Orders with the payment total of their lines; lines are pre-aggregated, so a hot order shrinks map-side."""
    paid = (read_parquet(spark, sf, "lineitem").groupBy("l_orderkey")
            .agg(exact_total(F.col("l_extendedprice")).alias("paid")))
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return (o.join(paid, o.o_orderkey == paid.l_orderkey).groupBy("o_orderpriority")
             .agg(F.count("*").alias("n_orders"), exact_total(F.col("paid")).alias("payment_value")))


@query("join_profile_left", f"""SELECT s.series_id, s.ds, {R('coalesce(p.revenue_profile, 1.0)', 6)} AS factor FROM x_sales s
    LEFT JOIN x_profile p ON p.series_id = s.series_id AND p.month = month(s.ds) AND p.day = day(s.ds)""")
def join_profile_left(spark, sf):
    daily = src.daily_once(spark, sf)
    profile = seasonal_profile(sp.load_panel(daily), ["revenue"])
    days = daily.select("series_id", "ds", F.month("ds").alias("month"), F.dayofmonth("ds").alias("day"))
    out = jn.lookup_default(days, profile, ["series_id", "month", "day"], "revenue_profile", F.lit(1.0))
    return out.select("series_id", "ds", sc.settle(F.col("revenue_profile"), 6).alias("factor"))


@query("align_dropna", f"""SELECT n.series_id, n.ds, {R('n.residual', 3)} AS a, t.sessions AS b FROM x_naive n JOIN x_traffic t ON t.ds = n.ds
    WHERE n.residual IS NOT NULL""")
def align_dropna(spark, sf):
    a = src.naive_panel(spark, sf).select("series_id", "ds", F.col("residual").alias("a"))
    b = src.traffic(spark, sf).select("ds", F.col("sessions").alias("b"))
    return jn.align(a, b, "ds").select("series_id", "ds", sc.settle(F.col("a"), 3).alias("a"), "b")


@query("align_left", "SELECT s.series_id, s.ds, t.sessions FROM x_spine s LEFT JOIN x_traffic t ON t.ds = s.ds")
def align_left(spark, sf):
    return jn.align_left(sp.date_spine(daily_sales(spark, sf)), src.traffic(spark, sf), "ds").select(
        "series_id", "ds", "sessions")


@query("index_intersect", """SELECT ds, revenue FROM x_sales_all WHERE ds IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def index_intersect(spark, sf):
    ships = read_parquet(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("ds")).distinct()
    return jn.index_intersect(daily_sales(spark, sf, None).select("ds", "revenue"), ships, ["ds"])


@query("interval_join_promo", """SELECT series_id, ds, revenue, CASE WHEN ds IN (SELECT ds FROM x_promo_days) THEN 1 ELSE 0 END AS is_promo
    FROM x_sales""")
def interval_join_promo(spark, sf):
    out = jn.interval_flag(daily_sales(spark, sf), promotions(spark, sf))
    return out.select("series_id", "ds", "revenue", "is_promo")


@query("event_window_join", f"""SELECT series_id, promo_name, "offset", ds, revenue FROM (
    SELECT p.series_id, e.promo_name, CAST(p.ds - e.start_date AS INTEGER) AS "offset", p.ds, {R('p.revenue', 3)} AS revenue,
    min(p.ds - e.start_date) OVER w AS lo, max(p.ds - e.start_date) OVER w AS hi
    FROM x_panel p JOIN x_promos e ON p.ds BETWEEN e.start_date - 7 AND e.start_date + 14
    WINDOW w AS (PARTITION BY p.series_id, e.promo_name)) WHERE lo = -7 AND hi = 14""")
def event_window_join(spark, sf):
    out = jn.event_window(src.panel(spark, sf), promotions(spark, sf), event="promo_name")
    return out.select("series_id", "promo_name", "offset", "ds", sc.settle(F.col("revenue"), 3).alias("revenue"))


def _lag_sql(days):
    return " ".join(f"LEFT JOIN x_panel l{n} ON l{n}.series_id = p.series_id AND l{n}.ds = p.ds - {n}" for n in days)


LAGS = (364, 365, 366, 730)


@query("lag_calendar", f"""SELECT p.series_id, p.ds, {', '.join(f"{R(f'l{n}.revenue', 3)} AS revenue_lag{n}" for n in LAGS)}
    FROM x_panel p {_lag_sql(LAGS)}""")
def lag_calendar(spark, sf):
    p = src.panel(spark, sf).select("series_id", "ds", "revenue")
    return p.select("series_id", "ds", *[
        sc.settle(wn.lag_days(F.col("revenue"), n), 3).alias(f"revenue_lag{n}") for n in LAGS])


@query("lookup_default", f"""SELECT f.series_id, f.ds, {R('coalesce(r.ratio, d.ratio_default)', 6)} AS ratio_pred FROM x_fc f
    LEFT JOIN x_ratio r ON r.series_id = f.series_id AND r.parity = year(f.ds) % 2 AND r.month = month(f.ds)
    LEFT JOIN x_ratio_default d ON d.series_id = f.series_id""")
def lookup_default(spark, sf):
    p = src.panel_once(spark, sf)
    table, default = seasonal_ratio(p, SPLIT["train_end"])
    out = apply_ratio(src.horizon(p), table, default)
    return out.select("series_id", "ds", sc.settle(F.col("ratio_pred"), 6).alias("ratio_pred"))


@query("patch_update", f"""SELECT n.series_id, n.ds, {R('coalesce(v.error, n.residual)', 3)} AS residual FROM (
    SELECT series_id, ds, CASE WHEN ds <= DATE '1999-12-31' THEN residual END AS residual FROM x_naive) n
    LEFT JOIN x_err v ON v.series_id = n.series_id AND v.ds = n.ds""")
def patch_update(spark, sf):
    n = cut_lineage(src.naive_panel(spark, sf))
    known = n.select("series_id", "ds", F.when(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])), F.col("residual")).alias("residual"))
    fresh = between(n, SPLIT["val_start"], SPLIT["val_end"]).select("series_id", "ds", "residual")
    out = jn.patch_update(known, fresh, ["series_id", "ds"], ["residual"])
    return out.select("series_id", "ds", sc.settle(F.col("residual"), 3).alias("residual"))


@query("semi_recurring", """WITH hot AS (SELECT series_id, month(ds) AS m, day(ds) AS d FROM x_sales GROUP BY 1, 2, 3
    HAVING avg(CASE WHEN cogs > revenue THEN 1 ELSE 0 END) >= 0.5)
    SELECT s.series_id, s.ds, hot.m IS NOT NULL AS is_recurring FROM x_sales s LEFT JOIN hot
    ON hot.series_id = s.series_id AND hot.m = month(s.ds) AND hot.d = day(s.ds)""")
def semi_recurring(spark, sf):
    """Mark the (month, day) pairs of a series that are loss days in at least half of the years."""
    s = src.daily_once(spark, sf)
    hot = (s.groupBy("series_id", F.month("ds").alias("month"), F.dayofmonth("ds").alias("day"))
            .agg(F.avg((F.col("cogs") > F.col("revenue")).cast("int")).alias("_r")).where(F.col("_r") >= 0.5))
    return jn.mark_recurring(s, hot).select("series_id", "ds", "is_recurring")
