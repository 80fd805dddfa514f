"""Aggregations, window operators, sorting, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidecast.functions import calendar as cal, scalars as sc
from tidecast.operators import aggregates as ag, baselines as bl, windows as wn
from tidecast.operators.evaluation import between
from tidecast.operators.forecasting import forecast_metrics
from tidecast.operators.joins import interval_flag
from tidecast.operators.ranks import average_rank, histogram_ranks
from tidecast.plans import inputs as src
from tidecast.plans.registry import query, settled as R
from tidecast.sources.bindings import SPLIT, daily_sales, inventory, orders_by_day, promotions
from tidecast.sources.tables import read_parquet

S = sc.settle
CLIP = "least(greatest(cogs / nullif(revenue, 0), 0.5), 1.6)"


# --- aggregations ------------------------------------------------------------------------------

@query("agg_basic", f"""SELECT series_id, sum(revenue) AS total, {R('avg(revenue)', 2)} AS mean, min(revenue) AS low,
    max(revenue) AS high, {R('stddev_samp(revenue)', 2)} AS std, count(*) AS n FROM x_sales GROUP BY 1""")
def agg_basic(spark, sf):
    return daily_sales(spark, sf).groupBy("series_id").agg(
        F.sum("revenue").alias("total"), S(F.avg("revenue"), 2).alias("mean"), F.min("revenue").alias("low"),
        F.max("revenue").alias("high"), S(F.stddev_samp("revenue"), 2).alias("std"), F.count("*").alias("n"))


@query("agg_named_multi", f"""SELECT snap, CAST(sum(units_sold) AS BIGINT) AS units_sold, {R('avg(sell_through_rate)', 6)} AS sell_through,
    {R('avg(stockout_flag)', 6)} AS stockout_pct, {R('avg(overstock_flag)', 6)} AS overstock_pct FROM x_inv GROUP BY 1""")
def agg_named_multi(spark, sf):
    return inventory(spark, sf).groupBy("snap").agg(
        F.sum("units_sold").alias("units_sold"), S(F.avg("sell_through_rate"), 6).alias("sell_through"),
        S(F.avg("stockout_flag"), 6).alias("stockout_pct"), S(F.avg("overstock_flag"), 6).alias("overstock_pct"))


@query("agg_median", f"""SELECT r.series_id, r.parity, r.month, {R('r.ratio', 6)} AS ratio, {R('d.ratio_default', 6)} AS ratio_default
    FROM x_ratio r JOIN x_ratio_default d USING (series_id)""")
def agg_median(spark, sf):
    from tidecast.operators.forecasting import seasonal_ratio
    table, default = seasonal_ratio(src.panel(spark, sf), SPLIT["train_end"])
    return table.join(default, "series_id").select(
        "series_id", "parity", "month", S(F.col("ratio"), 6).alias("ratio"), S(F.col("ratio_default"), 6).alias("ratio_default"))


@query("agg_quantiles", f"""SELECT series_id, CAST(month(ds) AS INTEGER) AS month, {R('avg(revenue)', 2)} AS mean,
    {R('quantile_cont(revenue, 0.25)', 2)} AS q25, {R('quantile_cont(revenue, 0.5)', 2)} AS q50,
    {R('quantile_cont(revenue, 0.75)', 2)} AS q75 FROM x_sales GROUP BY 1, 2""")
def agg_quantiles(spark, sf):
    q = daily_sales(spark, sf).groupBy("series_id", F.month("ds").alias("month")).agg(
        S(F.avg("revenue"), 2).alias("mean"),
        F.percentile("revenue", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return q.select("series_id", "month", "mean", *[S(F.col("_q")[i], 2).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@query("agg_rate", f"""SELECT series_id, {R('avg(CASE WHEN cogs > revenue THEN 1 ELSE 0 END) * 100', 6)} AS loss_pct,
    count(CASE WHEN cogs > revenue THEN 1 END) AS loss_days FROM x_sales GROUP BY 1""")
def agg_rate(spark, sf):
    loss = F.col("cogs") > F.col("revenue")
    return daily_sales(spark, sf).groupBy("series_id").agg(
        S(F.avg(loss.cast("int")) * 100, 6).alias("loss_pct"), F.count_if(loss).alias("loss_days"))


MONTHS = range(1, 13)


@query("pivot_year_month", f"""SELECT series_id, CAST(year(ds) AS INTEGER) AS year, {', '.join(
    f"{R(f'median(CASE WHEN month(ds) = {m} THEN cogs / nullif(revenue, 0) END)', 6)} AS M{m:02d}" for m in MONTHS)}
    FROM x_panel GROUP BY 1, 2""")
def pivot_year_month(spark, sf):
    out = ag.pivot_months(src.panel(spark, sf), sc.cogs_ratio(F.col("revenue"), F.col("cogs")), F.median)
    return out.select("series_id", "year", *[S(F.col(f"M{m:02d}"), 6).alias(f"M{m:02d}") for m in MONTHS])


@query("pivot_year_category", """SELECT CAST(year(ds) AS INTEGER) AS year, """ + ", ".join(
    f"coalesce(sum(CASE WHEN series_id = '{t}' THEN revenue END), 0) AS {t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM x_sales GROUP BY 1")
def pivot_year_category(spark, sf):
    """Revenue by year, one column per category of the data."""
    return ag.pivot_categories(daily_sales(spark, sf), "series_id", "revenue")


@query("category_long", """SELECT y.year, c.category, coalesce(s.revenue, 0) AS revenue FROM (SELECT DISTINCT CAST(year(ds) AS INTEGER) AS year FROM x_sales) y
    CROSS JOIN (SELECT DISTINCT series_id AS category FROM x_sales) c LEFT JOIN (SELECT CAST(year(ds) AS INTEGER) AS year, series_id AS category, sum(revenue) AS revenue FROM x_sales GROUP BY 1, 2) s
    ON s.year = y.year AND s.category = c.category""")
def category_long(spark, sf):
    """The same table in long form, for any number of categories."""
    return ag.category_years(daily_sales(spark, sf), "series_id", "revenue").withColumnRenamed("series_id", "category")


@query("share_cumulative", f"""SELECT category, revenue, {R('revenue / sum(revenue) OVER () * 100', 6)} AS share_pct,
    {R('sum(revenue) OVER (ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () * 100', 6)} AS cum_pct
    FROM (SELECT series_id AS category, sum(revenue) AS revenue FROM x_sales GROUP BY 1)""")
def share_cumulative(spark, sf):
    totals = daily_sales(spark, sf).groupBy(F.col("series_id").alias("category")).agg(F.sum("revenue").alias("revenue"))
    out = ag.share_cumulative(totals, "category", "revenue")
    return out.select("category", "revenue", S(F.col("share_pct"), 6).alias("share_pct"), S(F.col("cum_pct"), 6).alias("cum_pct"))


@query("geo_growth", f"""SELECT series_id, {R('revenue_growth', 6)} AS revenue_growth, {R('cogs_growth', 6)} AS cogs_growth FROM x_growth""")
def geo_growth(spark, sf):
    g = bl.geo_growth(bl.annual_totals(src.panel(spark, sf)))
    return g.select("series_id", S(F.col("revenue_growth"), 6).alias("revenue_growth"), S(F.col("cogs_growth"), 6).alias("cogs_growth"))


@query("argmax_row", """SELECT series_id, min(m) AS month, max(total) AS revenue FROM (
    SELECT *, max(total) OVER (PARTITION BY series_id) AS top FROM (
    SELECT series_id, CAST(month(ds) AS INTEGER) AS m, sum(revenue) AS total FROM x_sales GROUP BY 1, 2)) WHERE total = top GROUP BY 1""")
def argmax_row(spark, sf):
    monthly = daily_sales(spark, sf).groupBy("series_id", F.month("ds").alias("month")).agg(F.sum("revenue").alias("revenue"))
    return ag.argmax_row(monthly, "revenue", "month")


@query("family_stats", r"""SELECT regexp_replace(promo_name, '\s*\d{4}$', '') AS family, CAST(min(dayofyear(start_date)) AS INTEGER) AS doy_min,
    CAST(max(dayofyear(start_date)) AS INTEGER) AS doy_max, CAST(max(dayofyear(start_date)) - min(dayofyear(start_date)) AS INTEGER) AS spread,
    count(DISTINCT year) AS n_years, bool_and(year % 2 = 1) AND count(DISTINCT year) > 1 AS biennial FROM x_promos GROUP BY 1""")
def family_stats(spark, sf):
    return ag.family_stats(promotions(spark, sf))


@query("zero_variance", f"""SELECT flag, {R('min(x)', 6)} AS min_share, {R('median(x)', 6)} AS median_share, {R('max(x)', 6)} AS max_share,
    {R('var_samp(x)', 8)} AS variance, count(CASE WHEN x > 0.5 THEN 1 END) AS months_above_half, count(*) AS months FROM (
    SELECT 'stockout_flag' AS flag, stockout_pct AS x FROM x_month UNION ALL SELECT 'overstock_flag', overstock_pct FROM x_month) GROUP BY 1""")
def zero_variance(spark, sf):
    out = ag.flag_share_stats(inventory(spark, sf), ["stockout_flag", "overstock_flag"])
    return out.select("flag", S(F.col("min_share"), 6).alias("min_share"), S(F.col("median_share"), 6).alias("median_share"),
                      S(F.col("max_share"), 6).alias("max_share"), S(F.col("variance"), 8).alias("variance"),
                      "months_above_half", "months")


@query("flag_range_ratio", f"""SELECT {R('(max(overstock_pct) - min(overstock_pct)) / nullif(max(stockout_pct) - min(stockout_pct), 0)', 5)} AS range_ratio,
    max(overstock_pct) - min(overstock_pct) > max(stockout_pct) - min(stockout_pct) AS wider FROM x_month""")
def flag_range_ratio(spark, sf):
    """How many times wider the monthly share of one flag ranges than that of the other."""
    out = ag.range_ratio(ag.flag_share_stats(inventory(spark, sf), ["stockout_flag", "overstock_flag"]), "overstock_flag", "stockout_flag")
    return out.select(S(F.col("range_ratio"), 5).alias("range_ratio"), "wider")


@query("describe", f"""SELECT "column", count(x) AS n, {R('avg(x)', 2)} AS mean, {R('stddev_samp(x)', 2)} AS std, min(x) AS min,
    {R('quantile_cont(x, 0.25)', 2)} AS q25, {R('quantile_cont(x, 0.5)', 2)} AS q50, {R('quantile_cont(x, 0.75)', 2)} AS q75, max(x) AS max
    FROM (SELECT 'revenue' AS "column", revenue AS x FROM x_sales_all UNION ALL SELECT 'cogs', cogs FROM x_sales_all) GROUP BY 1""")
def describe(spark, sf):
    out = ag.describe(daily_sales(spark, sf, None), ["revenue", "cogs"])
    return out.select("column", "n", *[S(F.col(c), 2).alias(c) for c in ("mean", "std", "q25", "q50", "q75")], "min", "max")


@query("kpi_totals", f"""SELECT {R('sum(revenue)', 1)} AS revenue, {R('sum(cogs)', 1)} AS cogs, {R('sum(revenue) - sum(cogs)', 1)} AS profit,
    {R('(sum(revenue) - sum(cogs)) / sum(revenue) * 100', 6)} AS margin_pct, {R('avg(revenue)', 2)} AS revenue_per_day FROM x_fc""")
def kpi_totals(spark, sf):
    k = ag.kpi_totals(src.profile_fc(spark, sf))
    return k.select(S(F.col("revenue"), 1).alias("revenue"), S(F.col("cogs"), 1).alias("cogs"), S(F.col("profit"), 1).alias("profit"),
                    S(F.col("margin_pct"), 6).alias("margin_pct"), S(F.col("revenue_per_day"), 2).alias("revenue_per_day"))


# --- windows -----------------------------------------------------------------------------------

def _frame(lo, hi, part="series_id"):
    hi_text = "CURRENT ROW" if hi == 0 else f"{hi} FOLLOWING"
    return f"OVER (PARTITION BY {part} ORDER BY ds ROWS BETWEEN {lo} PRECEDING AND {hi_text})"


@query("rolling_centered", f"""SELECT series_id, ds, {R(f'CASE WHEN count(revenue) {_frame(15, 14)} >= 7 THEN avg(revenue) {_frame(15, 14)} END', 2)} AS mean,
    {R(f'CASE WHEN count(revenue) {_frame(15, 14)} >= 7 THEN stddev_samp(revenue) {_frame(15, 14)} END', 2)} AS std FROM x_panel""")
def rolling_centered(spark, sf):
    before, after = wn.centred(30)
    x = F.col("revenue")
    return src.panel(spark, sf).select(
        "series_id", "ds", S(wn.rolling_column(x, before, after, "mean", 7), 2).alias("mean"),
        S(wn.rolling_column(x, before, after, "std", 7), 2).alias("std"))


@query("rolling_lagged", f"""SELECT series_id, ds, {R('avg(revenue) OVER (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 392 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING)', 2)} AS roll28_lag365 FROM x_panel""")
def rolling_lagged(spark, sf):
    return src.panel(spark, sf).select("series_id", "ds", S(wn.lagged_mean(F.col("revenue"), 365, 28), 2).alias("roll28_lag365"))


@query("rolling_band", f"""SELECT series_id, ds, {R('m', 2)} AS band_mean, {R('s', 2)} AS band_std, {R('m + 2 * s', 2)} AS band_upper, {R('m - 2 * s', 2)} AS band_lower,
    coalesce(revenue > m + 2 * s, false) AS is_anomaly FROM (SELECT *, CASE WHEN count(revenue) {_frame(89, 0)} >= 90 THEN avg(revenue) {_frame(89, 0)} END AS m,
    CASE WHEN count(revenue) {_frame(89, 0)} >= 90 THEN stddev_samp(revenue) {_frame(89, 0)} END AS s FROM x_panel)""")
def rolling_band(spark, sf):
    out = wn.band(src.panel(spark, sf), "revenue")
    return out.select("series_id", "ds", *[S(F.col(c), 2).alias(c) for c in ("band_mean", "band_std", "band_upper", "band_lower")], "is_anomaly")


@query("rolling_smooth", f"""SELECT series_id, ds, {R(f'CASE WHEN count(revenue) {_frame(13, 0)} >= 14 THEN avg(revenue) {_frame(13, 0)} END', 2)} AS smooth14 FROM (
    SELECT *, max(ds) OVER (PARTITION BY series_id) AS top FROM x_panel) WHERE ds >= top - INTERVAL 2 YEAR""")
def rolling_smooth(spark, sf):
    return wn.smooth_recent(src.panel(spark, sf), "revenue", "smooth14").select("series_id", "ds", S(F.col("smooth14"), 2).alias("smooth14"))


@query("baseline_nonpromo", f"""WITH f AS (SELECT *, CASE WHEN ds IN (SELECT ds FROM x_promo_days) THEN 1 ELSE 0 END AS is_promo FROM x_panel),
    o AS (SELECT series_id, ds, CASE WHEN count(revenue) {_frame(29, 0)} >= 30 THEN avg(revenue) {_frame(29, 0)} END AS own FROM f WHERE is_promo = 0),
    b AS (SELECT f.*, last_value(own IGNORE NULLS) OVER (PARTITION BY f.series_id ORDER BY f.ds ROWS UNBOUNDED PRECEDING) AS baseline
          FROM f LEFT JOIN o ON o.series_id = f.series_id AND o.ds = f.ds)
    SELECT series_id, ds, is_promo, {R('baseline', 2)} AS baseline, {R('(revenue / baseline - 1) * 100', 4)} AS lift_pct FROM b""")
def baseline_nonpromo(spark, sf):
    flagged = interval_flag(src.panel(spark, sf), promotions(spark, sf))
    out = wn.baseline_outside(flagged, "revenue", "is_promo")
    return out.select("series_id", "ds", "is_promo", S(F.col("baseline"), 2).alias("baseline"), S(F.col("lift_pct"), 4).alias("lift_pct"))


@query("shift_rows", f"""SELECT series_id, ds, {R('lag(revenue, 14) OVER w', 3)} AS back14, {R('lead(revenue, 14) OVER w', 3)} AS ahead14,
    {R('lag(revenue, 1) OVER w', 3)} AS back1 FROM x_panel WINDOW w AS (PARTITION BY series_id ORDER BY ds)""")
def shift_rows(spark, sf):
    x = F.col("revenue")
    return src.panel(spark, sf).select("series_id", "ds", *[S(wn.shift_rows(x, k), 3).alias(n) for k, n in ((14, "back14"), (-14, "ahead14"), (1, "back1"))])


@query("yoy_change", f"""SELECT p.series_id, p.ds, {R('(p.revenue - l.revenue) / nullif(l.revenue, 0) * 100', 4)} AS yoy_pct FROM x_panel p
    LEFT JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 365""")
def yoy_change(spark, sf):
    return src.panel(spark, sf).select("series_id", "ds", S(wn.yoy_change(F.col("revenue")), 4).alias("yoy_pct"))


@query("annual_change", f"""SELECT series_id, year, {R('revenue', 1)} AS revenue, {R('(revenue - l) / l * 100', 6)} AS change_pct FROM (
    SELECT *, lag(revenue) OVER (PARTITION BY series_id ORDER BY year) AS l FROM x_annual)""")
def annual_change(spark, sf):
    out = bl.annual_change(bl.annual_totals(src.panel(spark, sf)), "revenue")
    return out.select("series_id", "year", S(F.col("revenue"), 1).alias("revenue"), S(F.col("change_pct"), 6).alias("change_pct"))


@query("group_transform", f"""SELECT series_id, ds, {R('(revenue - avg(revenue) OVER w) / stddev_samp(revenue) OVER w', 6)} AS z,
    {R('revenue / avg(revenue) OVER w', 6)} AS normed FROM x_panel WINDOW w AS (PARTITION BY series_id, year(ds))""")
def group_transform(spark, sf):
    x = F.col("revenue")
    mean, std = wn.year_stat(x, "mean"), wn.year_stat(x, "std")
    return src.panel(spark, sf).select("series_id", "ds", S(sc.z_score(x, mean, std), 6).alias("z"), S(sc.ratio(x, mean), 6).alias("normed"))


@query("ffill", """SELECT series_id, ds, last_value(revenue IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS revenue FROM x_dense""")
def ffill(spark, sf):
    from tidecast.operators.spine import fill_gaps
    dense = fill_gaps(daily_sales(spark, sf).repartition("series_id"))
    return dense.select("series_id", "ds", wn.forward_fill(F.col("revenue")).alias("revenue"))


@query("average_rank", """SELECT o_orderpriority, value, count(*) AS n, any_value(r) AS avg_rank FROM (SELECT o_orderpriority, o_totalprice AS value,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS r
    FROM orders) GROUP BY 1, 2""")
def average_rank_q(spark, sf):
    """Average rank of every order value inside its priority, by distributed value histogram."""
    counts = read_parquet(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_totalprice").alias("value")).agg(F.count("*").alias("n"))
    return histogram_ranks(counts, ["o_orderpriority"]).drop("ties")


@query("average_rank_daily", """SELECT series_id, ds, rank() OVER (PARTITION BY series_id ORDER BY revenue)
    + (count(*) OVER (PARTITION BY series_id, revenue) - 1) / 2.0 AS avg_rank FROM x_sales""")
def average_rank_daily(spark, sf):
    return daily_sales(spark, sf).select("series_id", "ds", average_rank(F.col("revenue"), ["series_id"]).alias("avg_rank"))


# --- sort, top-k, union ------------------------------------------------------------------------

@query("sort_output", "SELECT ds, revenue FROM x_sales_all ORDER BY revenue DESC, ds")
def sort_output(spark, sf):
    return daily_sales(spark, sf, None).select("ds", "revenue").orderBy(F.col("revenue").desc(), "ds")


@query("topk", "SELECT series_id, sum(revenue) AS revenue FROM x_sales GROUP BY 1 ORDER BY revenue DESC, series_id LIMIT 5")
def topk(spark, sf):
    """Top five categories by revenue (a report, so the limit is the feature)."""
    totals = daily_sales(spark, sf).groupBy("series_id").agg(F.sum("revenue").alias("revenue"))
    return totals.orderBy(F.col("revenue").desc(), "series_id").limit(5)


@query("tail_days", f"""SELECT series_id, ds, {R('y', 3)} AS y, {R('pred', 3)} AS pred FROM (SELECT *, max(ds) OVER (PARTITION BY series_id) AS top FROM x_err)
    WHERE ds > top - 180""")
def tail_days(spark, sf):
    v = src.naive_errors(spark, sf).withColumn("_top", F.max("ds").over(W.partitionBy("series_id")))
    return v.where(F.col("ds") > F.date_sub("_top", 180)).select("series_id", "ds", S(F.col("y"), 3).alias("y"), S(F.col("pred"), 3).alias("pred"))


@query("union_blocks", f"SELECT series_id, ds, {R('revenue', 2)} AS revenue FROM x_fc")
def union_blocks(spark, sf):
    fc = src.profile_fc(spark, sf).select("series_id", "ds", S(F.col("revenue"), 2).alias("revenue"))
    blocks = [between(fc, lo, hi) for lo, hi in (("2001-01-01", "2001-12-31"), ("2002-01-01", SPLIT["test_end"]))]
    return blocks[0].unionByName(blocks[1])


# --- scalar functions --------------------------------------------------------------------------

PARTS = ("year", "month", "day", "quarter", "dayofyear", "dayofweek", "weekofyear", "days_in_month", "is_month_end")


@query("calendar_parts", """SELECT DISTINCT ds, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day,
    CAST(quarter(ds) AS INTEGER) AS quarter, CAST(dayofyear(ds) AS INTEGER) AS dayofyear, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek,
    CAST(weekofyear(ds) AS INTEGER) AS weekofyear, CAST(day(last_day(ds)) AS INTEGER) AS days_in_month,
    CASE WHEN last_day(ds) = ds THEN 1 ELSE 0 END AS is_month_end FROM x_orders""")
def calendar_parts(spark, sf):
    days = orders_by_day(spark, sf).select("ds").distinct()
    return days.select("ds", *cal.calendar_columns(F.col("ds"), PARTS))


@query("calendar_plus", """SELECT DISTINCT ds, CAST(last_day(ds) - ds AS INTEGER) AS days_to_month_end, CAST((day(ds) - 1) // 7 + 1 AS INTEGER) AS week_of_month,
    CAST(1 - year(ds) % 2 AS INTEGER) AS is_even_year FROM x_orders""")
def calendar_plus(spark, sf):
    return _days(spark, sf, "days_to_month_end", "week_of_month", "is_even_year")


def _days(spark, sf, *names):
    return orders_by_day(spark, sf).select("ds").distinct().select("ds", *cal.calendar_columns(F.col("ds"), names))


@query("urban_expected", "SELECT DISTINCT ds, CASE WHEN month(ds) IN (7, 8) AND year(ds) % 2 = 1 THEN 1 ELSE 0 END AS urban_expected FROM x_orders")
def urban_expected(spark, sf):
    return _days(spark, sf, "urban_expected")


@query("days_to_promo", """SELECT DISTINCT ds, CAST(least(abs(dayofyear(ds) - 77), abs(dayofyear(ds) - 174), abs(dayofyear(ds) - 242), abs(dayofyear(ds) - 322), 60)
    AS INTEGER) AS days_to_promo FROM x_orders""")
def days_to_promo(spark, sf):
    return _days(spark, sf, "days_to_promo")


@query("parity_month", "SELECT CAST(year(ds) % 2 AS INTEGER) AS parity, CAST(month(ds) AS INTEGER) AS month, count(*) AS n_orders FROM x_orders GROUP BY 1, 2")
def parity_month(spark, sf):
    o = orders_by_day(spark, sf)
    return o.groupBy(cal.parity(F.col("ds")).alias("parity"), F.month("ds").alias("month")).agg(F.count("*").alias("n_orders"))


@query("promo_family", r"SELECT promo_name, regexp_replace(promo_name, '\s*\d{4}$', '') AS family FROM x_promos")
def promo_family(spark, sf):
    return promotions(spark, sf).select("promo_name", sc.strip_year(F.col("promo_name")).alias("family"))


@query("math", f"""SELECT series_id, ds, abs(revenue - cogs) AS gap, {R('sqrt(revenue)', 4)} AS root, greatest(revenue, cogs) AS high, least(revenue, cogs) AS low,
    {R('pow(revenue / 1000000.0, 2)', 6)} AS square_m, {R('cogs / nullif(revenue, 0)', 6)} AS safe FROM x_sales""")
def math(spark, sf):
    r, c = F.col("revenue"), F.col("cogs")
    return daily_sales(spark, sf).select(
        "series_id", "ds", F.abs(r - c).alias("gap"), S(F.sqrt(r), 4).alias("root"), F.greatest(r, c).alias("high"), F.least(r, c).alias("low"),
        S(F.pow(r / 1000000.0, 2), 6).alias("square_m"), S(sc.ratio(c, r), 6).alias("safe"))


@query("softmax_share", f"""WITH q AS (SELECT series_id, CAST(quarter(ds) AS INTEGER) AS quarter, avg((revenue - cogs) / nullif(revenue, 0)) AS score FROM x_sales GROUP BY 1, 2),
    z AS (SELECT *, (score - avg(score) OVER (PARTITION BY series_id)) / stddev_samp(score) OVER (PARTITION BY series_id) AS z FROM q),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY series_id)) AS e FROM z)
    SELECT series_id, quarter, {R('e / sum(e) OVER (PARTITION BY series_id) * 100', 5)} AS share_pct FROM e""")
def softmax_share(spark, sf):
    w = W.partitionBy("series_id")
    q = daily_sales(spark, sf).groupBy("series_id", F.quarter("ds").alias("quarter")).agg(
        F.avg(sc.ratio(F.col("revenue") - F.col("cogs"), F.col("revenue"))).alias("score"))
    z = q.withColumn("_z", sc.z_score(F.col("score"), F.avg("score").over(w), F.stddev_samp("score").over(w)))
    e = z.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return e.select("series_id", "quarter", S(F.col("_e") / F.sum("_e").over(w) * 100, 5).alias("share_pct"))


@query("scale_units", "SELECT series_id, sum(revenue) / 1000000.0 AS revenue_m, sum(revenue) / 1000000000.0 AS revenue_bn FROM x_sales GROUP BY 1")
def scale_units(spark, sf):
    return daily_sales(spark, sf).groupBy("series_id").agg(
        (F.sum("revenue") / 1e6).alias("revenue_m"), (F.sum("revenue") / 1e9).alias("revenue_bn"))


# --- flagship ----------------------------------------------------------------------------------

@query("yoy_accuracy", f"""SELECT series_id, CAST(year(ds) AS INTEGER) AS year, count(residual) AS n, {R('avg(abs(residual))', 2)} AS mae,
    {R('sqrt(avg(residual * residual))', 2)} AS rmse,
    {R('1 - sum(residual * residual) / nullif(count(residual) * var_pop(CASE WHEN residual IS NOT NULL THEN revenue END), 0)', 5)} AS r2,
    {R('avg(abs(residual / nullif(revenue, 0))) * 100', 3)} AS mape FROM x_naive WHERE residual IS NOT NULL GROUP BY 1, 2""")
def yoy_accuracy(spark, sf):
    """From line items to panel to forecast to error table: how good is the same-day-last-year forecast?"""
    p = bl.yoy_naive(src.panel(spark, sf)).where(F.col("pred").isNotNull()).withColumn("year", F.year("ds"))
    m = forecast_metrics(p, "revenue", "pred", by=("series_id", "year"))
    return m.select("series_id", "year", "n", S(F.col("mae"), 2).alias("mae"), S(F.col("rmse"), 2).alias("rmse"),
                    S(F.col("r2"), 5).alias("r2"), S(F.col("mape"), 3).alias("mape"))
