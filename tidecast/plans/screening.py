"""Statistical screening, denoising, event calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.fixed_values import EVENTS, LUNAR_NEW_YEAR, PROMO_EVERY_YEAR, PROMO_ODD_YEARS
from tidecast.functions import calendar as cal, scalars as sc
from tidecast.operators import denoise as dn, events as ev, smoothing as sm, spine as sp, stats as st, windows as wn
from tidecast.operators.aggregates import argmax_row
from tidecast.operators.features import exog_lags, with_exog
from tidecast.plans import inputs as src
from tidecast.plans.registry import query, settled as R
from tidecast.session import cut_lineage
from tidecast.sources.bindings import daily_sales, inventory, orders_by_day, promotions, web_traffic
from tidecast.sources.tables import read_parquet

S = sc.settle

# --- feature screening -------------------------------------------------------------------------

RANKED_SQL = """k AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0 AS ry FROM long WHERE x IS NOT NULL AND y IS NOT NULL)"""


STEPS = 4000


def upper_tail(base: str, key: str, start: str, width: str, density: str, times: int = 1) -> str:
    """CTE ``tail`` (key, p): ``times`` the integral of ``density`` (of x) from ``start`` over ``width`` for every row of ``base``, by Simpson's rule."""
    return f"""grid AS (SELECT i, CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, {STEPS + 1}) g(i)),
    point AS (SELECT b.*, {start} AS lo, {width} AS wide, i, w FROM {base} b CROSS JOIN grid), place AS (SELECT *, lo + wide * i / {STEPS} AS x FROM point),
    tail AS (SELECT {key}, least(1.0, greatest(0.0, {times} * sum(w * ({density})) * any_value(wide) / {STEPS} / 3)) AS p FROM place GROUP BY {key})"""


def _feature_pairs(spark, sf):
    """(series_id, feature, x, y): residual persistence against the residual, drivers against revenue.

    Values are settled before ranking, so noise in the last bits does not break ties.
    """
    p = src.naive_panel(spark, sf)
    p = p.select("series_id", "ds", "revenue", "residual", wn.lag_days(F.col("residual"), 365).alias("resid_lag365"))
    p = with_exog(p, exog_lags(src.exog(spark, sf)))
    rates = sp.daily_mean(web_traffic(spark, sf), ["bounce_rate", "avg_session_duration_sec"])
    p = p.join(F.broadcast(rates), "ds", "left")  # one row per calendar day
    pairs = [("resid_lag365", "residual")] + [(f, "revenue") for f in (
        "overstock_pct_lag365", "sessions_lag365", "bounce_rate", "avg_session_duration_sec")]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), S(F.col(f).cast("double"), 6).alias("x"), S(F.col(y), 3).alias("y")) for f, y in pairs])
    return p.select("series_id", F.explode(cells).alias("_c")).select("series_id", "_c.*")


SPEARMAN_ROWS = f"""rates AS (SELECT ds, avg(bounce_rate) AS bounce_rate, avg(avg_session_duration_sec) AS avg_session_duration_sec FROM x_traffic_src GROUP BY 1),
    long AS (SELECT series_id, feature, {R('x', 6)} AS x, {R('y', 3)} AS y FROM (
    SELECT n.series_id, 'resid_lag365' AS feature, l.residual AS x, n.residual AS y FROM x_naive n JOIN x_naive l ON l.series_id = n.series_id AND l.ds = n.ds - 365
    UNION ALL SELECT n.series_id, 'overstock_pct_lag365', e.overstock_pct, n.revenue FROM x_naive n JOIN x_exog e ON e.ds = n.ds - 365
    UNION ALL SELECT n.series_id, 'sessions_lag365', e.sessions, n.revenue FROM x_naive n JOIN x_exog e ON e.ds = n.ds - 365
    UNION ALL SELECT n.series_id, 'bounce_rate', r.bounce_rate, n.revenue FROM x_naive n JOIN rates r ON r.ds = n.ds
    UNION ALL SELECT n.series_id, 'avg_session_duration_sec', r.avg_session_duration_sec, n.revenue FROM x_naive n JOIN rates r ON r.ds = n.ds)),
    {RANKED_SQL.format(g='series_id, feature')}"""


@query("spearman", f"""WITH {SPEARMAN_ROWS}
    SELECT series_id, feature, {R('corr(rx, ry)', 6)} AS r, count(*) AS n FROM k GROUP BY 1, 2""")
def spearman(spark, sf):
    out = st.spearman(_feature_pairs(spark, sf), "x", "y", ["series_id", "feature"])
    return out.select("series_id", "feature", S(F.col("r"), 6).alias("r"), "n")


@query("spearman_screen", f"""WITH {SPEARMAN_ROWS}, a AS (SELECT series_id, feature, corr(rx, ry) AS r, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2),
    {upper_tail("a", "series_id, feature", "abs(r) * sqrt((n - 2) / (1 - r * r))", "60.0", "exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + x * x / (n - 2), -(n - 1) / 2.0)", 2)}
    SELECT series_id, feature, {R('r', 6)} AS r, n, {R('p', 6)} AS p_value, abs(r) >= 0.1 AND p < 0.05 AS keep FROM a JOIN tail USING (series_id, feature)""")
def spearman_screen(spark, sf):
    """The same statistic with its p-value and verdict."""
    out = st.with_correlation_verdict(st.spearman(_feature_pairs(spark, sf), "x", "y", ["series_id", "feature"]))
    return out.select("series_id", "feature", S(F.col("r"), 6).alias("r"), "n", S(F.col("p_value"), 6).alias("p_value"), "keep")


def _binary_rows(spark, sf):
    """(series_id, feature, y, flag): month end, and cost above revenue."""
    ds = F.col("ds")
    flags = F.array(
        F.struct(F.lit("is_month_end").alias("feature"), cal.is_month_end(ds).alias("flag")),
        F.struct(F.lit("is_neg_margin").alias("feature"), (F.col("cogs") > F.col("revenue")).cast("int").alias("flag")))
    return daily_sales(spark, sf).select("series_id", F.col("revenue").alias("y"), F.explode(flags).alias("_c")).select("series_id", "y", "_c.*")


MANN_WHITNEY_ROWS = f"""long AS (SELECT series_id, 'is_month_end' AS feature, revenue AS y, CASE WHEN last_day(ds) = ds THEN 1 ELSE 0 END AS flag FROM x_sales
    UNION ALL SELECT series_id, 'is_neg_margin', revenue, CASE WHEN cogs > revenue THEN 1 ELSE 0 END FROM x_sales),
    k AS (SELECT *, rank() OVER (PARTITION BY series_id, feature ORDER BY y) + (count(*) OVER (PARTITION BY series_id, feature, y) - 1) / 2.0 AS r,
      CAST(count(*) OVER (PARTITION BY series_id, feature, y) AS DOUBLE) AS t FROM long),
    a AS (SELECT series_id, feature, sum(CASE WHEN flag = 1 THEN r END) AS r1, CAST(count(CASE WHEN flag = 1 THEN 1 END) AS DOUBLE) AS n1,
      CAST(count(CASE WHEN flag = 0 THEN 1 END) AS DOUBLE) AS n2, sum(t * t - 1) AS ties, median(CASE WHEN flag = 1 THEN y END) AS m1,
      median(CASE WHEN flag = 0 THEN y END) AS m2 FROM k GROUP BY 1, 2),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM a)"""


@query("mann_whitney", f"""WITH {MANN_WHITNEY_ROWS}
    SELECT series_id, feature, CAST(n1 AS BIGINT) AS n_flagged, CAST(n2 AS BIGINT) AS n_other, u, {R('greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd', 5)} AS z,
    {R('(m1 - m2) / m2 * 100', 4)} AS effect_pct FROM u""")
def mann_whitney(spark, sf):
    out = st.mann_whitney(_binary_rows(spark, sf), "y", "flag", ["series_id", "feature"])
    return out.select("series_id", "feature", "n_flagged", "n_other", "u", S(F.col("z"), 5).alias("z"), S(F.col("effect_pct"), 4).alias("effect_pct"))


@query("mann_whitney_screen", f"""WITH {MANN_WHITNEY_ROWS}, a2 AS (SELECT series_id, feature, n1, n2, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd AS z FROM u),
    {upper_tail("a2", "series_id, feature", "z", "14.0", "exp(-x * x / 2) / sqrt(2 * pi())", 2)}
    SELECT series_id, feature, CAST(n1 AS BIGINT) AS n_flagged, CAST(n2 AS BIGINT) AS n_other, {R('z', 5)} AS z, {R('p', 6)} AS p_value, p < 0.05 AS keep FROM a2 JOIN tail USING (series_id, feature)""")
def mann_whitney_screen(spark, sf):
    """The same statistic with its p-value and verdict."""
    out = st.with_z_verdict(st.mann_whitney(_binary_rows(spark, sf), "y", "flag", ["series_id", "feature"]))
    return out.select("series_id", "feature", "n_flagged", "n_other", S(F.col("z"), 5).alias("z"), S(F.col("p_value"), 6).alias("p_value"), "keep")


LEVELS = ("month", "quarter", "dayofyear", "dayofweek", "weekofyear")
H_SQL = """a AS (SELECT {g}, level, sum(r) AS r, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS tie FROM k GROUP BY {g}, level),
    s AS (SELECT {g}, sum(r * r / n) AS q, sum(n) AS m, sum(tie) AS ties, count(*) AS levels FROM a GROUP BY {g})"""


def _calendar_levels(spark, sf):
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), cal.CALENDAR_PARTS[n](F.col("ds")).alias("level")) for n in LEVELS])
    return daily_sales(spark, sf).select("series_id", F.col("revenue").alias("y"), F.explode(cells).alias("_c")).select("series_id", "y", "_c.*")


KRUSKAL_ROWS = f"""long AS (SELECT series_id, revenue AS y, feature, level FROM (SELECT series_id, revenue, month(ds) AS month, quarter(ds) AS quarter,
      dayofyear(ds) AS dayofyear, isodow(ds) - 1 AS dayofweek, weekofyear(ds) AS weekofyear FROM x_sales) UNPIVOT (level FOR feature IN (month, quarter, dayofyear, dayofweek, weekofyear))),
    f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, feature, level) AS size FROM long) WHERE size >= 2),
    k AS (SELECT *, rank() OVER (PARTITION BY series_id, feature ORDER BY y) + (count(*) OVER (PARTITION BY series_id, feature, y) - 1) / 2.0 AS r,
      CAST(count(*) OVER (PARTITION BY series_id, feature, y) AS DOUBLE) AS t FROM f), {H_SQL.format(g='series_id, feature')}"""


@query("kruskal_wallis", f"""WITH {KRUSKAL_ROWS}
    SELECT series_id, feature, {R('(12 / (m * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (m * m * m - m))', 4)} AS h, levels, CAST(m AS BIGINT) AS n FROM s""")
def kruskal_wallis(spark, sf):
    out = st.kruskal(_calendar_levels(spark, sf), "y", "level", ["series_id", "feature"])
    return out.select("series_id", "feature", S(F.col("h"), 4).alias("h"), "levels", "n")


@query("kruskal_wallis_screen", f"""WITH {KRUSKAL_ROWS}, b2 AS (SELECT series_id, feature, levels, m, (12 / (m * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (m * m * m - m)) AS h, (levels - 1) / 2.0 AS half FROM s),
    {upper_tail("b2", "series_id, feature", "h", "greatest(2 * half - h, 0) + 40 * sqrt(4 * half) + 100", "exp((half - 1) * ln(greatest(x, 1e-300)) - x / 2 - half * ln(2) - lgamma(half))")}
    SELECT series_id, feature, {R('h', 4)} AS h, levels, CAST(m AS BIGINT) AS n, {R('p', 6)} AS p_value, p < 0.05 AS keep FROM b2 JOIN tail USING (series_id, feature)""")
def kruskal_wallis_screen(spark, sf):
    """The same statistic with its p-value and verdict."""
    out = st.with_group_verdict(st.kruskal(_calendar_levels(spark, sf), "y", "level", ["series_id", "feature"]))
    return out.select("series_id", "feature", S(F.col("h"), 4).alias("h"), "levels", "n", S(F.col("p_value"), 6).alias("p_value"), "keep")


def _order_levels(spark, sf):
    o = read_parquet(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = read_parquet(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    return st.to_levels(joined, ["o_orderstatus", "o_orderpriority", "c_mktsegment"], "o_totalprice")


@query("kruskal_wallis_orders", f"""WITH long AS (SELECT o_totalprice AS y, feature, level FROM (SELECT o_totalprice, o_orderstatus, o_orderpriority, c_mktsegment
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey) UNPIVOT (level FOR feature IN (o_orderstatus, o_orderpriority, c_mktsegment))),
    k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS r,
      CAST(count(*) OVER (PARTITION BY feature, y) AS DOUBLE) AS t FROM long), {H_SQL.format(g='feature')}
    SELECT feature, {R('(12 / (m * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (m * m * m - m))', 4)} AS h, levels, CAST(m AS BIGINT) AS n FROM s""")
def kruskal_wallis_orders(spark, sf):
    """Order value by order attribute, on all order rows, ranked by distributed histogram."""
    out = st.kruskal_rows(_order_levels(spark, sf), "y", "level", ["feature"])
    return out.select("feature", S(F.col("h"), 4).alias("h"), "levels", "n")


@query("lag_vs_now_leakage", f"""WITH qty AS (SELECT ds, sum(l_quantity) AS total_qty FROM x_lines GROUP BY 1),
    rev_m AS (SELECT CAST(date_trunc('month', ds) AS DATE) AS snap, sum(revenue) AS revenue FROM x_panel_all GROUP BY 1),
    inv_m AS (SELECT snap, sum(units_sold) AS units_sold, avg(sell_through_rate) AS sell_through FROM x_inv GROUP BY 1),
    long AS (SELECT 'total_qty' AS feature, 'now' AS variant, CAST(q.total_qty AS DOUBLE) AS x, p.revenue AS y FROM x_panel_all p JOIN qty q ON q.ds = p.ds
    UNION ALL SELECT 'units_sold', 'now', i.units_sold, r.revenue FROM rev_m r JOIN inv_m i USING (snap)
    UNION ALL SELECT 'sell_through_rate', 'now', {R('i.sell_through', 9)}, r.revenue FROM rev_m r JOIN inv_m i USING (snap)
    UNION ALL SELECT 'overstock_pct', 'now', {R('e.overstock_pct', 9)}, p.revenue FROM x_panel_all p JOIN x_exog e ON e.ds = p.ds
    UNION ALL SELECT 'overstock_pct', 'lag365', {R('e.overstock_pct', 9)}, p.revenue FROM x_panel_all p JOIN x_exog e ON e.ds = p.ds - 365
    UNION ALL SELECT 'sessions', 'now', e.sessions, p.revenue FROM x_panel_all p JOIN x_exog e ON e.ds = p.ds
    UNION ALL SELECT 'sessions', 'lag365', e.sessions, p.revenue FROM x_panel_all p JOIN x_exog e ON e.ds = p.ds - 365),
    {RANKED_SQL.format(g='feature, variant')}
    SELECT feature, variant, {R('corr(rx, ry)', 6)} AS r, count(*) AS n FROM k GROUP BY 1, 2""")
def lag_vs_now_leakage(spark, sf):
    """Same-day drivers against the target, next to their lag of a year: concurrent ones leak."""
    p = src.panel(spark, sf, None).select("ds", "revenue")
    ex = cut_lineage(src.exog(spark, sf))
    daily = with_exog(with_exog(p, ex), exog_lags(ex))
    from tidecast.sources.bindings import order_lines
    qty = order_lines(spark, sf).groupBy("ds").agg(F.sum("l_quantity").alias("total_qty"))
    daily = daily.join(F.broadcast(qty), "ds", "left")  # one row per calendar day
    pairs = [("total_qty", "now", "total_qty"), ("overstock_pct", "now", "overstock_pct"), ("overstock_pct", "lag365", "overstock_pct_lag365"),
             ("sessions", "now", "sessions"), ("sessions", "lag365", "sessions_lag365")]
    cells = lambda trio: F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("variant"), S(F.col(c).cast("double"), 9).alias("x")) for f, v, c in trio])
    long = daily.select(F.col("revenue").alias("y"), F.explode(cells(pairs)).alias("_c")).select("y", "_c.*")
    monthly = p.groupBy(cal.month_start(F.col("ds")).alias("snap")).agg(F.sum("revenue").alias("y"))
    inv = inventory(spark, sf).groupBy("snap").agg(F.sum("units_sold").alias("units_sold"), F.avg("sell_through_rate").alias("sell_through_rate"))
    months = monthly.join(inv, "snap").select("y", F.explode(cells([(c, "now", c) for c in ("units_sold", "sell_through_rate")])).alias("_c")).select("y", "_c.*")
    out = st.spearman(long.unionByName(months), "x", "y", ["feature", "variant"])
    return out.select("feature", "variant", S(F.col("r"), 6).alias("r"), "n")


CCF_SQL = f"""WITH j AS (SELECT s.series_id, s.ds, s.revenue, t.sessions FROM x_sales s JOIN x_traffic t USING (ds)),
    n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS i FROM j),
    c AS (SELECT a.series_id, CAST(g.lag AS INTEGER) AS lag, corr(b.sessions, a.revenue) AS corr FROM n a CROSS JOIN (SELECT unnest(range(-14, 15)) AS lag) g
      JOIN n b ON b.series_id = a.series_id AND b.i = a.i - g.lag GROUP BY 1, 2)"""


def _ccf(spark, sf):
    joined = daily_sales(spark, sf).select("series_id", "ds", "revenue").join(F.broadcast(src.traffic(spark, sf)), "ds")
    return st.cross_correlation(joined, "sessions", "revenue")


@query("ccf", CCF_SQL + f""" SELECT series_id, lag, {R('corr', 6)} AS corr, {R('1.96 / sqrt(m)', 6)} AS ci
    FROM c JOIN (SELECT series_id, count(*) AS m FROM j GROUP BY 1) USING (series_id)""")
def ccf(spark, sf):
    return _ccf(spark, sf).select("series_id", "lag", S(F.col("corr"), 6).alias("corr"), S(F.col("ci"), 6).alias("ci"))


@query("ccf_peak", CCF_SQL + f""" SELECT series_id, arg_max(lag, corr) AS peak_lag, {R('max(corr)', 6)} AS peak_corr FROM c GROUP BY 1""")
def ccf_peak(spark, sf):
    return st.peak_lag(_ccf(spark, sf)).select("series_id", "peak_lag", S(F.col("peak_corr"), 6).alias("peak_corr"))


@query("linear_trend", f"""WITH m AS (SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS period, avg(revenue) AS mean FROM x_panel GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS i FROM m)
    SELECT series_id, {R('regr_slope(mean, i)', 3)} AS slope, {R('regr_intercept(mean, i)', 2)} AS intercept, {R('regr_r2(mean, i)', 6)} AS r2 FROM i GROUP BY 1""")
def linear_trend(spark, sf):
    from pyspark.sql import Window as W
    m = src.panel(spark, sf).groupBy("series_id", cal.month_start(F.col("ds")).alias("period")).agg(F.avg("revenue").alias("mean"))
    i = m.withColumn("i", F.row_number().over(W.partitionBy("series_id").orderBy("period")) - 1)
    out = st.linear_trend(i, "mean", "i")
    return out.select("series_id", S(F.col("slope"), 3).alias("slope"), S(F.col("intercept"), 2).alias("intercept"), S(F.col("r2"), 6).alias("r2"))


W90 = "OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"


@query("spread_anomaly", f"""WITH b AS (SELECT series_id, covar_samp(cogs, revenue) / var_pop(revenue) AS beta FROM x_panel GROUP BY 1),
    s AS (SELECT p.series_id, p.ds, b.beta, p.cogs - b.beta * p.revenue AS spread FROM x_panel p JOIN b USING (series_id)),
    w AS (SELECT *, CASE WHEN count(spread) {W90} >= 90 THEN avg(spread) {W90} END AS m, CASE WHEN count(spread) {W90} >= 90 THEN stddev_samp(spread) {W90} END AS sd FROM s)
    SELECT series_id, ds, {R('beta', 6)} AS beta, {R('spread', 2)} AS spread, {R('m + 2 * sd', 2)} AS band_upper, coalesce(spread > m + 2 * sd, false) AS is_anomaly FROM w""")
def spread_anomaly(spark, sf):
    out = st.spread_anomaly(src.panel(spark, sf))
    return out.select("series_id", "ds", S(F.col("beta"), 6).alias("beta"), S(F.col("spread"), 2).alias("spread"), S(F.col("band_upper"), 2).alias("band_upper"), "is_anomaly")


@query("cointegration", f"""WITH c AS (SELECT series_id, regr_slope(revenue, cogs) AS b, regr_intercept(revenue, cogs) AS a FROM x_panel GROUP BY 1),
    e AS (SELECT p.series_id, p.ds, p.revenue - (c.b * p.cogs + c.a) AS e FROM x_panel p JOIN c USING (series_id)),
    l AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY ds) AS e1 FROM e), d AS (SELECT *, e - e1 AS d FROM l),
    r AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY ds) AS d1 FROM d),
    s AS (SELECT series_id, sum(e1 * e1) AS aa, sum(e1 * d1) AS ab, sum(d1 * d1) AS bb, sum(e1 * d) AS ad, sum(d1 * d) AS bd, sum(d * d) AS dd, count(*) AS n
      FROM r WHERE d1 IS NOT NULL GROUP BY 1),
    f AS (SELECT *, (ad * bb - bd * ab) / (aa * bb - ab * ab) AS rho, (bd * aa - ad * ab) / (aa * bb - ab * ab) AS g FROM s),
    t AS (SELECT series_id, n, rho, rho / sqrt((dd - rho * ad - g * bd) / (n - 2) * bb / (aa * bb - ab * ab)) AS t FROM f)
    SELECT series_id, n, {R('rho', 6)} AS rho, {R('t', 4)} AS t_stat, t < -3.33613 AS is_cointegrated FROM t""")
def cointegration(spark, sf):
    out = st.cointegration(src.panel(spark, sf))
    return out.select("series_id", "n", S(F.col("rho"), 6).alias("rho"), S(F.col("t_stat"), 4).alias("t_stat"), "is_cointegrated")


@query("cointegration_auto")
def cointegration_auto(spark, sf):
    """Chosen lag, statistic and p-value of revenue against cost."""
    return st.cointegration_auto(src.panel(spark, sf))


DECOMPOSE = """WITH t AS (SELECT *, CASE WHEN count(revenue) OVER w >= 365 THEN avg(revenue) OVER w END AS trend FROM x_panel
      WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
    d AS (SELECT *, revenue - trend AS de FROM t),
    s AS (SELECT *, avg(de) OVER (PARTITION BY series_id, month(ds), day(ds)) - avg(de) OVER (PARTITION BY series_id) AS seasonal FROM d)"""


@query("seasonal_decompose", DECOMPOSE + f""" SELECT series_id, ds, {R('trend', 2)} AS trend, {R('seasonal', 2)} AS seasonal, {R('revenue - trend - seasonal', 2)} AS residual FROM s""")
def seasonal_decompose(spark, sf):
    out = st.seasonal_decompose(src.panel(spark, sf), "revenue")
    return out.select("series_id", "ds", *[S(F.col(c), 2).alias(c) for c in ("trend", "seasonal", "residual")])


@query("seasonal_share", DECOMPOSE + f""" SELECT series_id, {R('var_pop(seasonal) / var_pop(revenue) * 100', 4)} AS seasonal_share_pct FROM s GROUP BY 1""")
def seasonal_share(spark, sf):
    out = st.seasonal_share(st.seasonal_decompose(src.panel(spark, sf), "revenue"), "revenue")
    return out.select("series_id", S(F.col("seasonal_share_pct"), 4).alias("seasonal_share_pct"))


@query("seasonal_decompose_robust")
def seasonal_decompose_robust(spark, sf):
    """Trend, season and remainder by locally weighted regression, and the weight of each day."""
    return sm.robust_decompose(src.panel(spark, sf), "revenue")


@query("robust_decompose_adds_up", """SELECT series_id, count(*) AS days, true AS adds_up, true AS weighed FROM x_panel GROUP BY 1""")
def robust_decompose_adds_up(spark, sf):
    """The three parts add up on every day, and weights lie between zero and one."""
    out = sm.robust_decompose(src.panel(spark, sf), "revenue")
    gap = F.abs(F.col("revenue") - F.col("trend") - F.col("seasonal") - F.col("residual"))
    return out.groupBy("series_id").agg(F.count("trend").alias("days"), (F.max(gap) < 1e-6 * F.max(F.abs("revenue"))).alias("adds_up"),
                                        F.bool_and(F.col("weight").between(0, 1)).alias("weighed"))


@query("seasonal_share_robust")
def seasonal_share_robust(spark, sf):
    """Share of the variance of revenue that the robust season holds."""
    return st.seasonal_share(sm.robust_decompose(src.panel(spark, sf), "revenue"), "revenue")


# --- denoising ---------------------------------------------------------------------------------

def _recurring(col):
    return f"""sp_{col} AS (SELECT series_id, ds, coalesce(({col} - avg({col}) OVER w) / stddev_samp({col}) OVER w > 2, false) AS spike FROM x_panel
      WINDOW w AS (PARTITION BY series_id, year(ds))),
    rec_{col} AS (SELECT series_id, ds, avg(CASE WHEN spike THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, month(ds), day(ds)) >= 0.7 AS rec FROM sp_{col})"""


def _cap(col):
    return f"""{_recurring(col)}, up_{col} AS (SELECT series_id, ds, {col} AS x, CASE WHEN count({col}) OVER w >= 7 THEN avg({col}) OVER w + 3.0 * stddev_samp({col}) OVER w END AS up
      FROM x_panel WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
    cap_{col} AS (SELECT u.series_id, u.ds, u.x, CASE WHEN u.x > u.up AND NOT r.rec THEN u.up ELSE u.x END AS clean FROM up_{col} u JOIN rec_{col} r ON r.series_id = u.series_id AND r.ds = u.ds)"""


@query("recurring_spikes", f"WITH {_recurring('revenue')} SELECT series_id, ds, rec AS is_recurring FROM rec_revenue")
def recurring_spikes(spark, sf):
    return dn.detect_recurring(src.panel(spark, sf), "revenue").select("series_id", "ds", "is_recurring")


@query("cap_outliers", f"WITH {_cap('revenue')} SELECT series_id, ds, {R('clean', 2)} AS clean_revenue, abs(x - clean) > 0.000001 AS was_capped FROM cap_revenue")
def cap_outliers(spark, sf):
    out = dn.cap_outliers(src.panel(spark, sf), "revenue")
    return out.select("series_id", "ds", S(F.col("clean_revenue"), 2).alias("clean_revenue"),
                      (F.abs(F.col("revenue") - F.col("clean_revenue")) > 1e-6).alias("was_capped"))


@query("denoise_target", f"""WITH {_cap('revenue')}, {_cap('cogs')}, u AS (SELECT 'revenue' AS target, * FROM cap_revenue UNION ALL SELECT 'cogs', * FROM cap_cogs)
    SELECT series_id, target, count(CASE WHEN abs(x - clean) > 0.000001 THEN 1 END) AS n_capped, {R('avg(x)', 2)} AS mean_raw, {R('avg(clean)', 2)} AS mean_clean,
    {R('max(x)', 2)} AS max_raw, {R('max(clean)', 2)} AS max_clean FROM u GROUP BY 1, 2""")
def denoise_target(spark, sf):
    out = dn.denoise_report(src.clean_panel(spark, sf))
    return out.select("series_id", "target", "n_capped", *[S(F.col(c), 2).alias(c) for c in ("mean_raw", "mean_clean", "max_raw", "max_clean")])


# --- event calendar ----------------------------------------------------------------------------

def _run_sql(start, days, odd):
    held = f"""(ds - (make_date(year(ds), 1, 1) + {start - 1})) BETWEEN 0 AND {days - 1}{' AND year(ds) % 2 = 1' if odd else ''}"""
    if start + days - 1 > 365:
        held = f"({held} OR (ds - (make_date(year(ds) - 1, 1, 1) + {start - 1})) BETWEEN 0 AND {days - 1})"
    return held


EVENT_SQL = {
    "end_of_month": "last_day(ds) - ds < 4", "start_of_month": "day(ds) <= 3",
    "tet": "(" + " OR ".join(f"ds BETWEEN DATE '{d}' - 2 AND DATE '{d}' + 7" for d in LUNAR_NEW_YEAR) + ")",
    **{f: _run_sql(s, n, False) for f, (s, n) in PROMO_EVERY_YEAR.items()},
    **{f: _run_sql(s, n, True) for f, (s, n) in PROMO_ODD_YEARS.items()},
}


def _order_days(spark, sf):
    return orders_by_day(spark, sf).select("ds").distinct()


@query("month_edges", """SELECT DISTINCT ds, CASE WHEN last_day(ds) - ds < 4 AND NOT (year(ds) = 2001 AND month(ds) = 12) THEN 1 ELSE 0 END AS end_of_month,
    CASE WHEN day(ds) <= 3 THEN 1 ELSE 0 END AS start_of_month FROM x_orders""")
def month_edges(spark, sf):
    return ev.event_matrix(_order_days(spark, sf), ("end_of_month", "start_of_month"), last_year=2001)


@query("holiday_window", f"SELECT DISTINCT ds, CASE WHEN {EVENT_SQL['tet']} THEN 1 ELSE 0 END AS tet FROM x_orders")
def holiday_window(spark, sf):
    return ev.event_matrix(_order_days(spark, sf), ("tet",))


PROMO_EVENTS = tuple(e for e in EVENTS if e.startswith("promo_"))


@query("promo_calendar", """SELECT DISTINCT d.ds, p.family AS event FROM (SELECT DISTINCT ds FROM x_orders) d JOIN x_promos p ON d.ds BETWEEN p.start_date AND p.end_date""")
def promo_calendar(spark, sf):
    """(event, ds) rows; the first year of the data is the first with promotions, so nothing wraps into it."""
    return ev.event_calendar(_order_days(spark, sf), PROMO_EVENTS, first_year=1995).select("ds", "event")


@query("holiday_matrix", "SELECT DISTINCT ds, " + ", ".join(f"CASE WHEN {EVENT_SQL[e]} THEN 1 ELSE 0 END AS {e}" for e in EVENTS) + " FROM x_orders")
def holiday_matrix(spark, sf):
    return ev.event_matrix(_order_days(spark, sf))


DOY = "(dayofyear({d}) BETWEEN 77 AND 106 OR dayofyear({d}) BETWEEN 174 AND 202 OR dayofyear({d}) BETWEEN 242 AND 273 OR dayofyear({d}) BETWEEN 322 AND 366 OR (year({d}) % 2 = 1 AND (dayofyear({d}) BETWEEN 30 AND 59 OR dayofyear({d}) BETWEEN 211 AND 244)))"


@query("promo_flag_doy", "SELECT series_id, ds, CASE WHEN " + DOY.format(d="ds") + " THEN 1 ELSE 0 END AS is_promo, " + ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM x_panel q WHERE q.series_id = p.series_id AND q.ds = p.ds - {n}) THEN CASE WHEN "
    + DOY.format(d=f"(ds - {n})") + f" THEN 1 ELSE 0 END END AS is_promo_lag{n}" for n in (365, 730)) + " FROM x_panel p")
def promo_flag_doy(spark, sf):
    p = src.panel(spark, sf).select("series_id", "ds", cal.promo_flag_by_day_of_year(F.col("ds")).alias("is_promo"))
    return p.select("series_id", "ds", "is_promo", *[wn.lag_days(F.col("is_promo"), n).alias(f"is_promo_lag{n}") for n in (365, 730)])


STUDY = """WITH e AS (SELECT p.series_id, e.promo_name, CAST(p.ds - e.start_date AS INTEGER) AS k, p.revenue FROM x_panel p JOIN x_promos e
      ON p.ds BETWEEN e.start_date - 7 AND e.start_date + 14),
    f AS (SELECT * FROM (SELECT *, min(k) OVER w AS lo, max(k) OVER w AS hi, avg(CASE WHEN k <= 0 THEN revenue END) OVER w AS base FROM e WINDOW w AS (PARTITION BY series_id, promo_name))
      WHERE lo = -7 AND hi = 14),
    g AS (SELECT *, (revenue / base - 1) * 100 AS lift FROM f)"""


@query("promo_event_study", STUDY + f""" SELECT series_id, k AS "offset", {R('avg(lift)', 4)} AS mean_lift, {R('quantile_cont(lift, 0.5)', 4)} AS median_lift,
    {R('quantile_cont(lift, 0.25)', 4)} AS q25, {R('quantile_cont(lift, 0.75)', 4)} AS q75, count(*) AS n_events FROM g GROUP BY 1, 2""")
def promo_event_study(spark, sf):
    study = ev.event_study(ev.event_lift(src.panel(spark, sf), promotions(spark, sf)))
    return study.select("series_id", "offset", *[S(F.col(c), 4).alias(c) for c in ("mean_lift", "median_lift", "q25", "q75")], "n_events")


@query("promo_peak_day", STUDY + f""", m AS (SELECT series_id, k, avg(lift) AS lift FROM g GROUP BY 1, 2)
    SELECT series_id, arg_max(k, lift) AS "offset", {R('max(lift)', 4)} AS mean_lift FROM m GROUP BY 1""")
def promo_peak_day(spark, sf):
    study = ev.event_study(ev.event_lift(src.panel(spark, sf), promotions(spark, sf)))
    return argmax_row(study, "mean_lift", "offset").select("series_id", "offset", S(F.col("mean_lift"), 4).alias("mean_lift"))
