"""Decision tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidecast.functions import calendar as cal, scalars as sc
from tidecast.operators import aggregates as ag, decisions as de
from tidecast.plans import inputs as src
from tidecast.plans.registry import query, settled as R
from tidecast.session import cut_lineage
from tidecast.sources.bindings import daily_sales, exact_total, inventory, order_lines

S = sc.settle


@query("revenue_trend", f"""WITH m AS (SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS period, avg(revenue) / 1000000.0 AS mean, stddev_samp(revenue) / 1000000.0 AS std FROM x_panel GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS i FROM m)
    SELECT series_id, period, {R('mean', 6)} AS mean_m, {R('mean - std', 6)} AS low_m, {R('mean + std', 6)} AS high_m,
    {R('regr_intercept(mean, i) OVER (PARTITION BY series_id) + regr_slope(mean, i) OVER (PARTITION BY series_id) * i', 6)} AS trend_m FROM i""")
def revenue_trend(spark, sf):
    """Monthly mean ± one deviation in millions, with its linear trend."""
    m = src.panel(spark, sf).groupBy("series_id", cal.month_start(F.col("ds")).alias("period")).agg(
        (F.avg("revenue") / 1e6).alias("mean"), (F.stddev_samp("revenue") / 1e6).alias("std"))
    w = W.partitionBy("series_id")
    i = m.withColumn("i", F.row_number().over(w.orderBy("period")) - 1)
    trend = F.regr_intercept("mean", "i").over(w) + F.regr_slope("mean", "i").over(w) * F.col("i")
    return i.withColumn("trend", trend).select(
        "series_id", "period", S(F.col("mean"), 6).alias("mean_m"), S(F.col("mean") - F.col("std"), 6).alias("low_m"),
        S(F.col("mean") + F.col("std"), 6).alias("high_m"), S(F.col("trend"), 6).alias("trend_m"))


MONTHS = range(1, 13)
MARGIN = "(revenue - cogs) / nullif(revenue, 0) * 100"


@query("margin_heatmap", f"""WITH p AS (SELECT series_id, CAST(year(ds) AS INTEGER) AS year, {', '.join(f"avg(CASE WHEN month(ds) = {m} THEN {MARGIN} END) AS M{m:02d}" for m in MONTHS)} FROM x_panel GROUP BY 1, 2)
    SELECT series_id, year, {', '.join(f"{R(f'M{m:02d}', 4)} AS M{m:02d}" for m in MONTHS)}, CAST({' + '.join(f"CASE WHEN M{m:02d} < 0 THEN 1 ELSE 0 END" for m in MONTHS)} AS INTEGER) AS negative_months FROM p""")
def margin_heatmap(spark, sf):
    wide = ag.pivot_months(src.panel(spark, sf), sc.margin_pct(F.col("revenue"), F.col("cogs")), F.avg)
    negative = sum((F.coalesce(F.col(f"M{m:02d}") < 0, F.lit(False)).cast("int") for m in MONTHS), F.lit(0))
    return wide.select("series_id", "year", *[S(F.col(f"M{m:02d}"), 4).alias(f"M{m:02d}") for m in MONTHS], negative.alias("negative_months"))


@query("category_mix", f"""WITH l AS (SELECT p_type AS category, CAST(year(ds) AS INTEGER) AS year, CAST(sum(CAST(l_quantity * p_retailprice - l_discount * 100 AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM x_lines GROUP BY 1, 2),
    t AS (SELECT category, sum(revenue) AS total FROM l GROUP BY 1),
    s AS (SELECT *, total / sum(total) OVER () * 100 AS share_pct, sum(total) OVER (ORDER BY total DESC, category ROWS UNBOUNDED PRECEDING) / sum(total) OVER () * 100 AS cum_pct FROM t)
    SELECT category, year, {R('revenue / 1000000000.0', 6)} AS revenue_bn, {R('share_pct', 5)} AS share_pct, {R('cum_pct', 5)} AS cum_pct FROM l JOIN s USING (category)""")
def category_mix(spark, sf):
    """Revenue by category and year, with each category's share of the total and the running share."""
    amount = sc.line_revenue(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_discount") * 100)
    yearly = cut_lineage(order_lines(spark, sf).groupBy(F.col("p_type").alias("category"), F.year("ds").alias("year")).agg(
        exact_total(amount).alias("revenue")))
    totals = ag.share_cumulative(yearly.groupBy("category").agg(F.sum("revenue").alias("total")), "category", "total")
    return yearly.join(totals, "category").select(
        "category", "year", S(F.col("revenue") / 1e9, 6).alias("revenue_bn"), S(F.col("share_pct"), 5).alias("share_pct"), S(F.col("cum_pct"), 5).alias("cum_pct"))


@query("inventory_signal", f"""SELECT snap, {R('stockout_pct', 6)} AS stockout_pct, {R('overstock_pct', 6)} AS overstock_pct, {R('fill_rate', 6)} AS fill_rate FROM x_month""")
def inventory_signal(spark, sf):
    return inventory(spark, sf).groupBy("snap").agg(
        S(F.avg("stockout_flag"), 6).alias("stockout_pct"), S(F.avg("overstock_flag"), 6).alias("overstock_pct"), S(F.avg("fill_rate"), 6).alias("fill_rate"))


@query("safety_stock_tradeoff", f"""SELECT e.series_id, CAST(b.b AS INTEGER) AS buffer_pct, {R('avg(CASE WHEN e.rel_error > b.b / 100.0 THEN 1 ELSE 0 END) * 100', 5)} AS stockout_pct,
    {R('avg(greatest(b.b / 100.0 - e.rel_error, 0)) * 100', 4)} AS excess_pct FROM x_err e CROSS JOIN (SELECT unnest(range(0, 31)) AS b) b WHERE e.rel_error IS NOT NULL GROUP BY 1, 2""")
def safety_stock_tradeoff(spark, sf):
    out = de.buffer_tradeoff(src.naive_errors(spark, sf), "rel_error")
    return out.select("series_id", "buffer_pct", S(F.col("stockout_pct"), 5).alias("stockout_pct"), S(F.col("excess_pct"), 4).alias("excess_pct"))


@query("month_end_risk", f"""SELECT series_id, {R('avg(CASE WHEN day(ds) < 25 THEN CASE WHEN rel_error > 0.15 THEN 1 ELSE 0 END END) * 100', 5)} AS mid_risk_15,
    {R('avg(CASE WHEN day(ds) >= 25 THEN CASE WHEN rel_error > 0.15 THEN 1 ELSE 0 END END) * 100', 5)} AS end_risk_15,
    {R('avg(CASE WHEN day(ds) >= 25 THEN CASE WHEN rel_error > 0.20 THEN 1 ELSE 0 END END) * 100', 5)} AS end_risk_20 FROM x_err WHERE rel_error IS NOT NULL GROUP BY 1""")
def month_end_risk(spark, sf):
    out = de.month_end_risk(src.naive_errors(spark, sf), "rel_error")
    return out.select("series_id", *[S(F.col(c), 5).alias(c) for c in ("mid_risk_15", "end_risk_15", "end_risk_20")])


@query("marketing_allocation", f"""WITH q AS (SELECT s.series_id, CAST(quarter(s.ds) AS INTEGER) AS quarter, avg({MARGIN}) AS margin_pct, avg(revenue / sessions) AS revenue_per_session
      FROM x_sales s JOIN x_traffic t USING (ds) GROUP BY 1, 2), z AS (SELECT *, margin_pct * revenue_per_session AS score FROM q),
    e AS (SELECT *, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM z WINDOW w AS (PARTITION BY series_id)), f AS (SELECT *, exp(z - max(z) OVER (PARTITION BY series_id)) AS e FROM e)
    SELECT series_id, quarter, {R('margin_pct', 4)} AS margin_pct, {R('revenue_per_session', 3)} AS revenue_per_session, {R('score', 2)} AS score,
    {R('e / sum(e) OVER (PARTITION BY series_id) * 100', 5)} AS share_pct FROM f""")
def marketing_allocation(spark, sf):
    out = de.marketing_allocation(daily_sales(spark, sf), src.traffic(spark, sf))
    return out.select("series_id", "quarter", S(F.col("margin_pct"), 4).alias("margin_pct"), S(F.col("revenue_per_session"), 3).alias("revenue_per_session"),
                      S(F.col("score"), 2).alias("score"), S(F.col("share_pct"), 5).alias("share_pct"))


WARN = """WITH j AS (SELECT p.series_id, p.ds, p.revenue, t.sessions FROM x_panel p LEFT JOIN x_traffic t USING (ds)),
    y AS (SELECT a.series_id, a.ds, (a.sessions - b.sessions) / b.sessions * 100.0 AS traffic_yoy, (a.revenue - b.revenue) / nullif(b.revenue, 0) * 100 AS revenue_yoy
      FROM j a JOIN j b ON b.series_id = a.series_id AND b.ds = a.ds - 365 WHERE a.sessions IS NOT NULL AND b.sessions IS NOT NULL)"""


@query("early_warning_points", WARN + f""" SELECT series_id, ds, {R('traffic_yoy', 4)} AS traffic_yoy, {R('revenue_yoy', 4)} AS revenue_yoy,
    CASE WHEN traffic_yoy > 0 AND revenue_yoy > 0 THEN 'green' WHEN traffic_yoy < -20 THEN 'red' ELSE 'yellow' END AS zone FROM y""")
def early_warning_points(spark, sf):
    out = de.early_warning_points(src.panel(spark, sf), src.traffic(spark, sf))
    return out.select("series_id", "ds", S(F.col("traffic_yoy"), 4).alias("traffic_yoy"), S(F.col("revenue_yoy"), 4).alias("revenue_yoy"), "zone")


@query("early_warning_slope", WARN + f""" SELECT series_id, {R('regr_slope(revenue_yoy, traffic_yoy)', 5)} AS slope, {R('regr_intercept(revenue_yoy, traffic_yoy)', 3)} AS intercept FROM y GROUP BY 1""")
def early_warning_slope(spark, sf):
    from tidecast.operators.stats import linear_trend
    out = linear_trend(de.early_warning_points(src.panel(spark, sf), src.traffic(spark, sf)), "revenue_yoy", "traffic_yoy")
    return out.select("series_id", S(F.col("slope"), 5).alias("slope"), S(F.col("intercept"), 3).alias("intercept"))


@query("zone_rule", WARN + f""" SELECT series_id, ds, {R('traffic_yoy', 4)} AS traffic_yoy, CASE WHEN traffic_yoy >= -10 THEN 'green' WHEN traffic_yoy >= -20 THEN 'yellow' ELSE 'red' END AS zone,
    CASE WHEN traffic_yoy >= -10 THEN '<15%' WHEN traffic_yoy >= -20 THEN '~25%' ELSE '~37%' END AS probability,
    CASE WHEN traffic_yoy >= -10 THEN 'monitor as usual' WHEN traffic_yoy >= -20 THEN 'raise buffer by 5%, alert supply chain'
    ELSE 'stop non-essential promotions, raise buffer by 10%, report to finance' END AS action FROM y""")
def zone_rule(spark, sf):
    points = de.early_warning_points(src.panel(spark, sf), src.traffic(spark, sf))
    return de.warning_zone(points).select("series_id", "ds", S(F.col("traffic_yoy"), 4).alias("traffic_yoy"), "zone", "probability", "action")


@query("quarter_plan", f"""SELECT series_id, year(ds) || 'Q' || quarter(ds) AS period, {R('sum(revenue)', 1)} AS revenue, {R('sum(cogs)', 1)} AS cogs, {R('sum(revenue) - sum(cogs)', 1)} AS profit,
    {R('(sum(revenue) - sum(cogs)) / sum(revenue) * 100', 5)} AS margin_pct FROM x_fc GROUP BY 1, 2""")
def quarter_plan(spark, sf):
    out = de.quarter_plan(src.profile_fc(spark, sf))
    return out.select("series_id", "period", *[S(F.col(c), 1).alias(c) for c in ("revenue", "cogs", "profit")], S(F.col("margin_pct"), 5).alias("margin_pct"))


@query("stock_plan", f"""SELECT series_id, strftime(ds, '%Y-%m') AS period, {R('sum(revenue)', 1)} AS revenue, {R('sum(revenue) * 1.15', 1)} AS stock_target FROM x_fc GROUP BY 1, 2""")
def stock_plan(spark, sf):
    out = de.stock_plan(src.profile_fc(spark, sf), 15)
    return out.select("series_id", "period", S(F.col("revenue"), 1).alias("revenue"), S(F.col("stock_target"), 1).alias("stock_target"))


@query("budget_split", f"""WITH a AS (SELECT series_id, sum(revenue) * 0.02 AS budget FROM x_fc WHERE year(ds) = 2001 GROUP BY 1)
    SELECT series_id, CAST(q AS INTEGER) AS quarter, CAST(p AS INTEGER) AS share_pct, {R('budget * p / 100', 2)} AS quarter_budget FROM a CROSS JOIN (VALUES (1, 43), (2, 37), (3, 5), (4, 14)) v(q, p)""")
def budget_split(spark, sf):
    """Two percent of the year's forecast revenue, split over its quarters."""
    fc = src.profile_fc(spark, sf).where(F.year("ds") == 2001)
    year = fc.groupBy("series_id").agg((F.sum("revenue") * 0.02).alias("budget"))
    quarters = year.select("series_id", "budget", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    return de.budget_split(quarters, "budget").select("series_id", "quarter", "share_pct", S(F.col("quarter_budget"), 2).alias("quarter_budget"))


@query("clearance_audit", f"""SELECT series_id, count(CASE WHEN cogs > revenue THEN 1 END) AS loss_days, {R('avg(CASE WHEN cogs > revenue THEN 1 ELSE 0 END) * 100', 6)} AS loss_pct,
    count(DISTINCT CASE WHEN cogs > revenue THEN strftime(ds, '%Y-%m') END) AS loss_months FROM x_fc GROUP BY 1""")
def clearance_audit(spark, sf):
    out = de.clearance_audit(src.profile_fc(spark, sf))
    return out.select("series_id", "loss_days", S(F.col("loss_pct"), 6).alias("loss_pct"), "loss_months")


@query("forecast_band", f"""SELECT series_id, ds, {R('revenue', 2)} AS revenue, {R('revenue * 1.22', 2)} AS upper, {R('revenue * (2 - 1.22)', 2)} AS lower FROM x_fc""")
def forecast_band(spark, sf):
    out = de.forecast_band(src.profile_fc(spark, sf))
    return out.select("series_id", "ds", *[S(F.col(c), 2).alias(c) for c in ("revenue", "upper", "lower")])
