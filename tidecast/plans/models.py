"""Forecasting: baselines, structural and boosted models, recursion, metrics, evaluation."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tidecast.fixed_values import ALL_FEATURES
from tidecast.functions import scalars as sc
from tidecast.operators import arma as am, baselines as bl, boosting as bt, evaluation as evl, forecasting as fc, recursive as rc
from tidecast.operators import structural as su
from tidecast.operators.features import exog_lags, future_safe_features, with_exog
from tidecast.operators.windows import lag_days, shift_rows
from tidecast.plans import inputs as src
from tidecast.plans.registry import query, settled as R
from tidecast.session import cut_lineage, shared_folder
from tidecast.sources.bindings import SPLIT

S = sc.settle
KEYS = ["series_id"]
VAL = "BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"

def _model_inputs(spark, sf):
    """Denoised panel and driver table, written once because several models read them."""
    return src.clean_panel_once(spark, sf), cut_lineage(src.exog(spark, sf))


# --- model-free forecasts ----------------------------------------------------------------------

@query("yoy_naive", f"SELECT series_id, ds, {R('structural_pred', 3)} AS pred FROM x_naive")
def yoy_naive(spark, sf):
    return bl.yoy_naive(src.panel(spark, sf)).select("series_id", "ds", S(F.col("pred"), 3).alias("pred"))


@query("seasonal_profile_growth", f"SELECT series_id, ds, {R('revenue', 2)} AS revenue_pred, {R('cogs', 2)} AS cogs_pred FROM x_fc")
def seasonal_profile_growth(spark, sf):
    return src.profile_fc(spark, sf).select("series_id", "ds", S(F.col("revenue"), 2).alias("revenue_pred"), S(F.col("cogs"), 2).alias("cogs_pred"))


@query("residual_series", f"SELECT series_id, ds, {R('structural_pred', 2)} AS structural_pred, {R('residual', 2)} AS residual FROM x_state")
def residual_series(spark, sf):
    """Actual minus structure; NULL over the horizon."""
    return src.profile_state(spark, sf).select("series_id", "ds", S(F.col("structural_pred"), 2).alias("structural_pred"), S(F.col("residual"), 2).alias("residual"))


# --- features ----------------------------------------------------------------------------------

@query("exog_table", f"""SELECT ds, sessions, {R('overstock_pct', 6)} AS overstock_pct, {R('days_of_supply', 4)} AS days_of_supply, {R('fill_rate', 6)} AS fill_rate FROM x_exog""")
def exog_table(spark, sf):
    return src.exog(spark, sf).select("ds", "sessions", S(F.col("overstock_pct"), 6).alias("overstock_pct"), S(F.col("days_of_supply"), 4).alias("days_of_supply"),
                                      S(F.col("fill_rate"), 6).alias("fill_rate"))


PLACES = {"resid_lag365": 2, "resid_lag364": 2, "resid_lag366": 2, "resid_lag730": 2, "resid_roll28_lag365": 2, "structural_trend": 2,
          "fill_rate_lag365": 6, "days_of_supply_lag365": 4, "overstock_pct_lag365": 6, "fill_rate_lag730": 6}


@query("future_safe_features", f"""SELECT n.series_id, n.ds, {', '.join(f"{R(f'l{k}.residual', 2)} AS resid_lag{k}" for k in (364, 365, 366, 730))},
    {R('avg(n.residual) OVER (PARTITION BY n.series_id ORDER BY n.ds RANGE BETWEEN INTERVAL 392 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING)', 2)} AS resid_roll28_lag365,
    {R('n.structural_trend', 2)} AS structural_trend, {R('e.fill_rate', 6)} AS fill_rate_lag365, {R('e.days_of_supply', 4)} AS days_of_supply_lag365,
    {R('e.overstock_pct', 6)} AS overstock_pct_lag365, e.sessions AS sessions_lag365, {R('f.fill_rate', 6)} AS fill_rate_lag730, f.sessions AS sessions_lag730,
    CAST(1 - year(n.ds) % 2 AS INTEGER) AS is_even_year, CASE WHEN month(n.ds) IN (7, 8) AND year(n.ds) % 2 = 1 THEN 1 ELSE 0 END AS urban_expected,
    CAST(least(abs(dayofyear(n.ds) - 77), abs(dayofyear(n.ds) - 174), abs(dayofyear(n.ds) - 242), abs(dayofyear(n.ds) - 322), 60) AS INTEGER) AS days_to_promo,
    CAST(month(n.ds) AS INTEGER) AS month, CAST(isodow(n.ds) - 1 AS INTEGER) AS dayofweek, CASE WHEN last_day(n.ds) = n.ds THEN 1 ELSE 0 END AS is_month_end,
    CAST(weekofyear(n.ds) AS INTEGER) AS weekofyear, CAST(quarter(n.ds) AS INTEGER) AS quarter, CAST(dayofyear(n.ds) AS INTEGER) AS dayofyear,
    CAST(last_day(n.ds) - n.ds AS INTEGER) AS days_to_month_end, CAST((day(n.ds) - 1) // 7 + 1 AS INTEGER) AS week_of_month
    FROM x_naive n {' '.join(f"LEFT JOIN x_naive l{k} ON l{k}.series_id = n.series_id AND l{k}.ds = n.ds - {k}" for k in (364, 365, 366, 730))}
    LEFT JOIN x_exog e ON e.ds = n.ds - 365 LEFT JOIN x_exog f ON f.ds = n.ds - 730""")
def future_safe_features_q(spark, sf):
    """The 23-column matrix on the same-day-last-year structure."""
    state = with_exog(src.naive_panel(spark, sf), exog_lags(src.exog(spark, sf)))
    out = future_safe_features(state)
    return out.select("series_id", "ds", *[S(F.col(c), PLACES[c]).alias(c) if c in PLACES else F.col(c) for c in ALL_FEATURES])


# --- fitted models -----------------------------------------------------------------------------

@query("structural_fit")
def structural_fit(spark, sf):
    """Coefficients of the multiplicative model, long form."""
    coef = su.structural_fit(src.clean_panel(spark, sf), "clean_revenue", train_end=SPLIT["train_end"])
    both = F.array(F.struct(F.lit("trend").alias("part"), F.col("trend_coef").alias("c")), F.struct(F.lit("season").alias("part"), F.col("season_coef").alias("c")))
    return coef.select("series_id", F.explode(both).alias("_p")).select("series_id", "_p.part", F.posexplode("_p.c").alias("k", "coef"))


@query("structural_optimality", """SELECT series_id, mode, 0.0 AS trend_violation, 0.0 AS season_violation, true AS sparse FROM (SELECT DISTINCT series_id FROM x_panel)
    CROSS JOIN (VALUES ('additive'), ('multiplicative')) m(mode)""")
def structural_optimality(spark, sf):
    """Gradient of both fitted forms against the pull of their priors, to six digits of the series maximum, and whether the prior zeroed slope changes."""
    p = src.clean_panel_once(spark, sf)
    parts = []
    for mode in ("additive", "multiplicative"):
        params = su.StructuralParams(mode=mode)
        coef = cut_lineage(su.structural_fit(p, "clean_revenue", params, SPLIT["train_end"]))
        found = su.optimality(coef, p, "clean_revenue", params, SPLIT["train_end"])
        parts.append(found.select("series_id", F.lit(mode).alias("mode"), S(F.col("trend_violation"), 6).alias("trend_violation"),
                                  S(F.col("season_violation"), 6).alias("season_violation"), (F.col("changes") < params.n_knots).alias("sparse")))
    return parts[0].unionByName(parts[1])


@query("structural_interval")
def structural_interval(spark, sf):
    """Prediction with the bounds of simulated trend changes over the horizon."""
    p = src.clean_panel_once(spark, sf)
    coef = cut_lineage(su.structural_fit(p, "clean_revenue", train_end=SPLIT["val_end"]))
    return su.simulated_interval(coef, src.horizon(p))


@query("structural_fit_additive")
def structural_fit_additive(spark, sf):
    """Additive model without promotion events, scored on the validation year."""
    params = su.StructuralParams(mode="additive").without_promos()
    state = evl.model_state(src.clean_panel_once(spark, sf), None, SPLIT["train_end"], SPLIT["val_end"], "revenue", params)
    val = evl.between(state, SPLIT["val_start"], SPLIT["val_end"])
    return fc.forecast_metrics(val, "actual", "structural_pred", by=("series_id",))


@query("structural_predict")
def structural_predict(spark, sf):
    p = src.clean_panel_once(spark, sf)
    coef = su.structural_fit(p, "clean_revenue", train_end=SPLIT["train_end"])
    return su.structural_predict(coef, src.date_spine(p, end=SPLIT["test_end"]))


def _fitted(spark, sf, boost=bt.SHALLOW_TREES):
    """Tree tables of all series, the feature matrix, and its training part."""
    panel, exog = _model_inputs(spark, sf)
    state = evl.model_state(panel, exog, SPLIT["train_end"], SPLIT["val_end"])
    feats = cut_lineage(evl.hybrid_features(state))
    train = feats.where(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])))
    return cut_lineage(bt.fit_trees(train, "residual", ALL_FEATURES, boost)), feats, train


# rows of the training matrix that have every feature: all lags of the residual and of the drivers
TRAIN_ROWS = """SELECT p.series_id, p.ds FROM x_panel p JOIN x_exog e ON e.ds = p.ds - 365 JOIN x_exog f ON f.ds = p.ds - 730 """ + " ".join(
    f"JOIN x_panel l{k} ON l{k}.series_id = p.series_id AND l{k}.ds = p.ds - {k}" for k in (364, 365, 366, 730)) + """ WHERE p.ds <= DATE '1999-12-31'
    AND e.fill_rate IS NOT NULL AND e.days_of_supply IS NOT NULL AND e.overstock_pct IS NOT NULL AND e.sessions IS NOT NULL AND f.fill_rate IS NOT NULL AND f.sessions IS NOT NULL"""


@query("gbt_residual_fit")
def gbt_residual_fit(spark, sf):
    """Training error of the residual learner next to the size of the residual itself."""
    trees, _, train = _fitted(spark, sf)
    scored = bt.predict_trees(trees, train.dropna(subset=[*ALL_FEATURES, "residual"]))
    return scored.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg(F.abs("residual")).alias("residual_mae"),
        F.avg(F.abs(F.col("residual") - F.col("residual_pred"))).alias("fitted_mae"))


@query("gbt_residual_trees", f"""SELECT series_id, CAST(300 AS BIGINT) AS rounds, count(*) AS train_rows, true AS three_questions, true AS covers_all_rows, true AS error_reduced FROM ({TRAIN_ROWS}) GROUP BY 1""")
def gbt_residual_trees(spark, sf):
    """The fitted forest in numbers: 300 trees of three questions a series on all complete rows, and what it explains of them."""
    trees, _, train = _fitted(spark, sf)
    shape = trees.groupBy("series_id").agg(
        F.count("*").alias("rounds"), F.max("train_rows").alias("train_rows"), F.bool_and(F.size("features") == 3).alias("three_questions"),
        F.bool_and(F.aggregate("covers", F.lit(0).cast("bigint"), lambda a, x: a + x) == F.col("train_rows")).alias("covers_all_rows"))
    scored = bt.predict_trees(trees, train.dropna(subset=[*ALL_FEATURES, "residual"]))
    error = scored.groupBy("series_id").agg((F.avg(F.abs(F.col("residual") - F.col("residual_pred"))) < F.avg(F.abs("residual"))).alias("error_reduced"))
    return shape.join(error, "series_id")


SPLIT_FEATURES = ("month", "dayofweek", "is_month_end", "week_of_month", "is_even_year", "urban_expected")


@query("boosting_first_split", f"""WITH r AS (SELECT series_id, ds, residual FROM x_naive WHERE residual IS NOT NULL AND ds <= DATE '1999-12-31'),
    m AS (SELECT series_id, avg(residual) AS mean, count(*) AS n, var_pop(residual) * count(*) AS ss FROM r GROUP BY 1),
    c AS (SELECT r.series_id, residual - mean AS g, unnest([{{'f': 0, 'v': month(ds)}}, {{'f': 1, 'v': isodow(ds) - 1}}, {{'f': 2, 'v': CASE WHEN last_day(ds) = ds THEN 1 ELSE 0 END}},
        {{'f': 3, 'v': (day(ds) - 1) // 7 + 1}}, {{'f': 4, 'v': 1 - year(ds) % 2}}, {{'f': 5, 'v': CASE WHEN month(ds) IN (7, 8) AND year(ds) % 2 = 1 THEN 1 ELSE 0 END}}], recursive := true) FROM r JOIN m USING (series_id)),
    b AS (SELECT series_id, f, v, sum(g) AS g, count(*) AS n FROM c GROUP BY 1, 2, 3),
    s AS (SELECT *, sum(g) OVER o AS lg, sum(n) OVER o AS ln, lead(v) OVER (PARTITION BY series_id, f ORDER BY v) AS next FROM b WINDOW o AS (PARTITION BY series_id, f ORDER BY v)),
    k AS (SELECT s.series_id, f, (v + next) / 2 AS cut, round((lg * lg / (ln + 3) + lg * lg / (m.n - ln + 3)) / ss, 9) AS gain FROM s JOIN m USING (series_id) WHERE next IS NOT NULL)
    SELECT series_id, list_extract({list(SPLIT_FEATURES)}, f + 1) AS feature, CAST(cut AS DOUBLE) AS cut, {R('gain', 6)} AS gain_share FROM k QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, f, cut) = 1""")
def boosting_first_split(spark, sf):
    """The first question of the first tree over calendar features, and the share of the variation it removes (L2 of 3)."""
    rows = src.naive_panel(spark, sf).where(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])))
    rows = cut_lineage(future_safe_features(rows, keep=("residual",)).where(F.col("residual").isNotNull()))
    trees = bt.fit_trees(rows, "residual", SPLIT_FEATURES, bt.TreeParams(rounds=1, depth=1))
    spread = rows.groupBy("series_id").agg((F.var_pop("residual") * F.count("*")).alias("ss"))
    return trees.join(spread, "series_id").select("series_id", F.col("features")[0].alias("feature"), F.col("cuts")[0].alias("cut"),
                                                  S(F.col("gains")[0] / F.col("ss"), 6).alias("gain_share"))


@query("gbt_residual_fit_early_stop")
def gbt_residual_fit_early_stop(spark, sf):
    """The sampled learner with the last training year held out: trees kept of up to 1000, and the held-out error."""
    panel, exog = _model_inputs(spark, sf)
    state = evl.model_state(panel, exog, SPLIT["train_end"], SPLIT["val_end"])
    rows = evl.hybrid_features(state).withColumn("held_out", F.year("ds") == 1999)
    trees = bt.fit_trees(rows, "residual", ALL_FEATURES, replace(bt.SAMPLED_TREES, rounds=1000, patience=50), held_out="held_out")
    return trees.groupBy("series_id").agg(F.count("*").alias("trees"), F.max("train_rows").alias("train_rows"), F.max("held_out_mae").alias("held_out_mae"))


@query("gbt_residual_predict")
def gbt_residual_predict(spark, sf):
    trees, feats, _ = _fitted(spark, sf)
    return bt.predict_trees(trees, feats).select("series_id", "ds", "structural_pred", "residual_pred")


# --- blending, ratio, recursion ----------------------------------------------------------------

LEARNER_SQL = """(coalesce(max(residual) OVER (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING), 0)
    + coalesce(avg(residual) OVER (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 392 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING), 0)) / 2"""
RECURSE = f"""WITH b1 AS (SELECT * FROM (SELECT series_id, ds, structural_pred, {LEARNER_SQL} AS proxy FROM x_state) WHERE ds BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'),
    r1 AS (SELECT s.series_id, s.ds, s.structural_pred, coalesce(b.proxy, s.residual) AS residual FROM x_state s LEFT JOIN b1 b ON b.series_id = s.series_id AND b.ds = s.ds),
    b2 AS (SELECT * FROM (SELECT series_id, ds, structural_pred, {LEARNER_SQL} AS proxy FROM r1) WHERE ds BETWEEN DATE '2002-01-01' AND DATE '2002-07-01'),
    rec AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""


def _recursed(spark, sf):
    state = cut_lineage(src.profile_state(spark, sf))
    return state, rc.recursive_forecast(state, rc.naive_residual, SPLIT["test_start"], SPLIT["test_end"])


@query("blend", f"""SELECT series_id, ds, {R('structural_pred + proxy', 2)} AS forecast FROM (SELECT series_id, ds, structural_pred, {LEARNER_SQL} AS proxy FROM x_state) WHERE ds {VAL}""")
def blend(spark, sf):
    feats = future_safe_features(src.profile_state(spark, sf), keep=("structural_pred",))
    scored = rc.naive_residual(evl.between(feats, SPLIT["val_start"], SPLIT["val_end"]))
    return scored.select("series_id", "ds", S(fc.blend(F.col("structural_pred"), F.col("residual_pred")), 2).alias("forecast"))


@query("seasonal_ratio", f"""SELECT f.series_id, f.ds, {R('f.revenue', 2)} AS revenue_pred, {R('f.revenue * coalesce(r.ratio, d.ratio_default)', 2)} AS cogs_pred FROM x_fc f
    LEFT JOIN x_ratio r ON r.series_id = f.series_id AND r.parity = year(f.ds) % 2 AND r.month = month(f.ds) LEFT JOIN x_ratio_default d ON d.series_id = f.series_id""")
def seasonal_ratio(spark, sf):
    p = src.panel_once(spark, sf)
    rev = src.profile_fc(spark, sf, p).select("series_id", "ds", F.col("revenue").alias("revenue_pred"))
    out = fc.cogs_from_ratio(rev, p, SPLIT["train_end"])
    return out.select("series_id", "ds", S(F.col("revenue_pred"), 2).alias("revenue_pred"), S(F.col("cogs_pred"), 2).alias("cogs_pred"))


@query("recursive_forecast", RECURSE + f" SELECT series_id, ds, {R('proxy', 2)} AS residual, {R('structural_pred + proxy', 2)} AS forecast FROM rec")
def recursive_forecast(spark, sf):
    return _recursed(spark, sf)[1].select("series_id", "ds", S(F.col("residual"), 2).alias("residual"), S(F.col("forecast"), 2).alias("forecast"))


@query("recursive_forecast_boosted")
def recursive_forecast_boosted(spark, sf):
    """The whole pipeline: denoise, structure, boosted residual, recursion, cost ratio, post-processing."""
    panel, exog = _model_inputs(spark, sf)
    return fc.postprocess(evl.full_forecast(panel, exog, SPLIT))


@query("patch_actual_residuals", f"""SELECT series_id, ds, {R('residual', 2)} AS residual FROM x_state""")
def patch_actual_residuals(spark, sf):
    """Residuals known to the end of training, then patched with every actual up to the horizon."""
    p = src.panel_once(spark, sf)
    state = src.profile_state(spark, sf, p)
    known = state.withColumn("residual", F.when(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])), F.col("residual"))).drop("revenue")
    out = rc.patch_actual_residuals(known, p, SPLIT["val_start"], "2000-12-31")
    return out.select("series_id", "ds", S(F.col("residual"), 2).alias("residual"))


@query("drift_ratio", RECURSE + f""", base AS (SELECT series_id, avg(abs(residual)) AS b FROM x_state WHERE ds {VAL} GROUP BY 1)
    SELECT series_id, CAST(year(ds) AS INTEGER) AS year, {R('avg(abs(proxy))', 2)} AS proxy_mae, {R('any_value(b)', 2)} AS baseline_mae, {R('avg(abs(proxy)) / any_value(b)', 6)} AS drift
    FROM rec JOIN base USING (series_id) GROUP BY 1, 2""")
def drift_ratio(spark, sf):
    state, forecast = _recursed(spark, sf)
    out = fc.drift_ratio(forecast, evl.between(state, SPLIT["val_start"], SPLIT["val_end"]))
    return out.select("series_id", "year", S(F.col("proxy_mae"), 2).alias("proxy_mae"), S(F.col("baseline_mae"), 2).alias("baseline_mae"), S(F.col("drift"), 6).alias("drift"))


@query("postprocess", f"""SELECT series_id, ds, {R('round_even(greatest(revenue - 200000, 0), 2)', 2)} AS revenue, {R('round_even(greatest(cogs, 0), 2)', 2)} AS cogs FROM x_fc""")
def postprocess(spark, sf):
    """Forecast lowered by a constant, so that the zero clip acts."""
    f = src.profile_fc(spark, sf).withColumn("revenue", F.col("revenue") - 200000)
    out = fc.postprocess(f)
    return out.select("series_id", "ds", S(F.col("revenue"), 2).alias("revenue"), S(F.col("cogs"), 2).alias("cogs"))


@query("loss_audit", f"""SELECT series_id, count(CASE WHEN cogs > revenue THEN 1 END) AS loss_days, count(*) AS days,
    {R('avg(CASE WHEN cogs > revenue THEN 1 ELSE 0 END) * 100', 6)} AS loss_pct, avg(CASE WHEN cogs > revenue THEN 1 ELSE 0 END) * 100 > 20 AS suspicious FROM x_fc GROUP BY 1""")
def loss_audit(spark, sf):
    out = fc.loss_audit(src.profile_fc(spark, sf))
    return out.select("series_id", "loss_days", "days", S(F.col("loss_pct"), 6).alias("loss_pct"), "suspicious")


@query("delivery", f"""SELECT series_id, ds, round_even(greatest(revenue, 0), 2) AS revenue, round_even(greatest(cogs, 0), 2) AS cogs FROM x_fc WHERE ds <= DATE '2002-06-30'
    UNION ALL SELECT DISTINCT series_id, DATE '2002-07-02', NULL, NULL FROM x_fc""")
def delivery(spark, sf):
    """The whole last step on a template that lacks the last day and has one beyond the horizon: forecast, clip, round, template dates, CSV in fixed order, read back."""
    f = fc.postprocess(src.profile_fc(spark, sf))
    template = cut_lineage(f.select("series_id", F.when(F.col("ds") == F.to_date(F.lit("2002-07-01")), F.to_date(F.lit("2002-07-02"))).otherwise(F.col("ds")).alias("ds")))
    path = f"{shared_folder(spark)}/delivery-{uuid.uuid4().hex}"
    fc.deliver(template, f, path)
    return fc.delivered(spark, path, template.schema["series_id"].dataType.simpleString())


@query("prediction_interval", f"""SELECT f.series_id, f.ds, {R('f.revenue', 2)} AS forecast, {R('greatest(f.revenue - 1.96 * s.sd, 0)', 2)} AS lower_95, {R('f.revenue + 1.96 * s.sd', 2)} AS upper_95
    FROM x_fc f JOIN (SELECT series_id, stddev_samp(error) AS sd FROM x_err GROUP BY 1) s USING (series_id)""")
def prediction_interval(spark, sf):
    p = src.panel_once(spark, sf)
    f = src.profile_fc(spark, sf, p).select("series_id", "ds", F.col("revenue").alias("forecast"))
    out = fc.prediction_interval(f, src.naive_errors(spark, sf, p))
    return out.select("series_id", "ds", *[S(F.col(c), 2).alias(c) for c in ("forecast", "lower_95", "upper_95")])


METRICS_SQL = f"""count(e) AS n, {R('avg(abs(e))', 2)} AS mae, {R('sqrt(avg(e * e))', 2)} AS rmse, {R('1 - sum(e * e) / nullif(count(e) * var_pop(y), 0)', 5)} AS r2,
    {R('avg(abs(e / nullif(y, 0))) * 100', 3)} AS mape"""


def _settled_metrics(m, *by):
    return m.select(*by, "n", S(F.col("mae"), 2).alias("mae"), S(F.col("rmse"), 2).alias("rmse"), S(F.col("r2"), 5).alias("r2"), S(F.col("mape"), 3).alias("mape"))


@query("forecast_metrics", f"""WITH l AS (SELECT 'yoy' AS model, 'revenue' AS target, p.series_id, p.revenue AS y, p.revenue - l.revenue AS e FROM x_panel p JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 365 WHERE p.ds {VAL}
    UNION ALL SELECT 'yoy', 'cogs', p.series_id, p.cogs, p.cogs - l.cogs FROM x_panel p JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 365 WHERE p.ds {VAL}
    UNION ALL SELECT 'two_years', 'revenue', p.series_id, p.revenue, p.revenue - l.revenue FROM x_panel p JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 730 WHERE p.ds {VAL})
    SELECT model, target, series_id, {METRICS_SQL} FROM l GROUP BY 1, 2, 3""")
def forecast_metrics(spark, sf):
    p = src.panel(spark, sf)
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"_{t}_{n}").alias("pred"))
                      for m, t, n in (("yoy", "revenue", 365), ("yoy", "cogs", 365), ("two_years", "revenue", 730))])
    wide = p.select("*", *[lag_days(F.col(t), n).alias(f"_{t}_{n}") for t in ("revenue", "cogs") for n in (365, 730)])
    long = evl.between(wide, SPLIT["val_start"], SPLIT["val_end"]).select("series_id", F.explode(cells).alias("_c")).select("series_id", "_c.*")
    return _settled_metrics(fc.forecast_metrics(long, by=("model", "target", "series_id")), "model", "target", "series_id")


@query("split_check", """SELECT series_id, true AS out_of_sample, 1 AS gap_days, count(CASE WHEN ds <= DATE '1999-12-31' THEN 1 END) AS train_days, 366 AS val_days,
    count(CASE WHEN ds <= DATE '1999-12-31' THEN 1 END) >= 365 AS enough_history FROM x_panel GROUP BY 1""")
def split_check(spark, sf):
    return fc.split_check(src.panel(spark, sf), SPLIT["train_end"], SPLIT["val_start"], SPLIT["val_end"])


# --- evaluation --------------------------------------------------------------------------------

FOLDS = [dict(name="1999", train_end="1998-12-31", val_start="1999-01-01", val_end="1999-12-31"),
         dict(name="1999-2000", train_end="1998-12-31", val_start="1999-01-01", val_end="2000-12-31"),
         dict(name="2000", train_end="1999-12-31", val_start="2000-01-01", val_end="2000-12-31")]


@query("backtest_naive", "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"('{f['name']}', DATE '{f['val_start']}', DATE '{f['val_end']}')" for f in FOLDS)
       + f""") v(fold, lo, hi)), l AS (SELECT f.fold, n.series_id, n.revenue AS y, n.residual AS e FROM x_naive n JOIN f ON n.ds BETWEEN f.lo AND f.hi)
    SELECT fold, series_id, {METRICS_SQL} FROM l GROUP BY 1, 2""")
def backtest_naive(spark, sf):
    return _settled_metrics(evl.backtest_naive(src.panel(spark, sf), FOLDS), "fold", "series_id")


@query("backtest")
def backtest(spark, sf):
    panel, exog = _model_inputs(spark, sf)
    return evl.backtest(panel, exog, FOLDS)


@query("backtest_days", "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"('{f['name']}', DATE '{f['val_start']}', DATE '{f['val_end']}')" for f in FOLDS) + f""") v(fold, lo, hi)),
    l AS (SELECT fold, p.revenue, p.cogs, l.revenue AS nr, l.cogs AS nc FROM x_panel p JOIN f ON p.ds BETWEEN f.lo AND f.hi LEFT JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 365)
    SELECT fold, 'revenue' AS target, count(*) AS n, {R('avg(abs(revenue - nr))', 2)} AS naive_mae FROM l GROUP BY 1
    UNION ALL SELECT fold, 'cogs', count(*), {R('avg(abs(cogs - nc))', 2)} FROM l GROUP BY 1""")
def backtest_days(spark, sf):
    """Days and last-year error of every fold and target as scored by the full backtest."""
    panel, exog = _model_inputs(spark, sf)
    out = evl.backtest(panel, exog, FOLDS)
    return out.select("fold", "target", "n", S(F.col("naive_mae"), 2).alias("naive_mae"))


@query("model_comparison")
def model_comparison(spark, sf):
    panel, exog = _model_inputs(spark, sf)
    return evl.model_comparison(panel, exog, SPLIT)


@query("independent_cogs")
def independent_cogs(spark, sf):
    """Cost from a model of its own, against actual cost."""
    panel, _ = _model_inputs(spark, sf)
    params = su.StructuralParams(mode="additive").without_promos()
    own = evl.hybrid_validation(panel, None, SPLIT, "cogs", params, evl.BASE_FEATURES, bt.SAMPLED_TREES)
    return fc.forecast_metrics(own, "actual", "pred", by=("series_id",))


@query("ratio_structural")
def ratio_structural(spark, sf):
    """Cost ratio extrapolated by the structural model, against the actual ratio."""
    panel = src.clean_panel_once(spark, sf)
    params = su.StructuralParams(mode="additive").without_promos()
    pred = evl.ratio_structural(panel, SPLIT, params)
    actual = panel.select("series_id", "ds", sc.cogs_ratio(F.col("revenue"), F.col("cogs")).alias("y"))
    return fc.forecast_metrics(pred.join(actual, ["series_id", "ds"]), "y", "ratio_pred", by=("series_id",))


@query("feature_ablation")
def feature_ablation(spark, sf):
    panel, exog = _model_inputs(spark, sf)
    state = evl.model_state(panel, exog, SPLIT["train_end"], SPLIT["val_end"])
    return evl.feature_ablation(evl.ablation_features(state), SPLIT)


@query("expanding_folds", """SELECT series_id, ds, CAST(CASE WHEN i <= n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4)) - 1) // (n // 4) + 1 END AS INTEGER) AS fold FROM (
    SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM x_panel WHERE ds <= DATE '1999-12-31')""")
def expanding_folds(spark, sf):
    train = src.panel(spark, sf).where(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])))
    return evl.expanding_folds(train).select("series_id", "ds", "fold")


def _train_features(spark, sf, series: str | None = "p_type"):
    panel, exog = src.clean_panel_once(spark, sf, series), cut_lineage(src.exog(spark, sf))
    state = evl.model_state(panel, exog, SPLIT["train_end"], SPLIT["val_end"])
    return evl.hybrid_features(state).where(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"])))


@query("expanding_cv")
def expanding_cv(spark, sf):
    return evl.expanding_cv(_train_features(spark, sf))


@query("param_search")
def param_search(spark, sf):
    """Fifty trials over three folds of the company's residual."""
    return evl.param_search(_train_features(spark, sf, None))


@query("feature_importance")
def feature_importance(spark, sf):
    """Share of the gain per series and feature."""
    return bt.split_importance(_fitted(spark, sf)[0], ("series_id",))


@query("permutation_importance")
def permutation_importance(spark, sf):
    trees, feats, _ = _fitted(spark, sf)
    val = evl.between(feats, SPLIT["val_start"], SPLIT["val_end"]).withColumn("label", F.col("actual") - F.col("structural_pred"))
    return bt.shuffled_errors(trees, val, "label")


def _explained(spark, sf):
    trees, feats, _ = _fitted(spark, sf)
    return bt.shapley_values(trees, evl.between(feats, SPLIT["val_start"], SPLIT["val_end"]))


@query("shapley_importance")
def shapley_importance(spark, sf):
    """Mean and mean absolute Shapley value of each feature over the validation year, all series."""
    return bt.shapley_importance(_explained(spark, sf))


@query("shapley_additivity", f"""SELECT series_id, count(*) AS days, true AS adds_up FROM x_panel WHERE ds {VAL} GROUP BY 1""")
def shapley_additivity(spark, sf):
    """Do the base value and the effects of every day add up to its prediction?"""
    total = F.aggregate("effects", F.col("base_value"), lambda a, x: a + x)
    return _explained(spark, sf).groupBy("series_id").agg(
        F.count("*").alias("days"), (F.max(F.abs(total - F.col("prediction"))) <= 1e-6 * F.max(F.abs("prediction"))).alias("adds_up"))


@query("ar_baseline")
def ar_baseline(spark, sf):
    """Forecast of the validation year by five autoregressive and two moving-average terms on differences."""
    panel = src.panel_once(spark, sf)
    pred = am.arma_forecast(panel, "revenue", SPLIT["train_end"], SPLIT["val_end"])
    return pred.join(panel.select("series_id", "ds", F.col("revenue").alias("y")), ["series_id", "ds"])


@query("ar_baseline_days", f"""SELECT series_id, count(*) AS days, count(*) AS forecasts, true AS below_spread FROM x_panel WHERE ds {VAL} GROUP BY 1""")
def ar_baseline_days(spark, sf):
    """Every day of the validation year has a forecast, and the one-step deviation is below that of the differences themselves."""
    panel = src.panel_once(spark, sf)
    pred = am.arma_forecast(panel, "revenue", SPLIT["train_end"], SPLIT["val_end"])
    val = evl.between(panel, SPLIT["val_start"], SPLIT["val_end"]).join(pred, ["series_id", "ds"], "left")
    counts = val.groupBy("series_id").agg(F.count("*").alias("days"), F.count("pred").alias("forecasts"))
    train = panel.where(F.col("ds") <= F.to_date(F.lit(SPLIT["train_end"]))).withColumn("d", F.col("revenue") - shift_rows(F.col("revenue"), 1))
    spread = train.groupBy("series_id").agg(F.stddev_pop("d").alias("spread"))
    fit = am.arma_coefficients(panel, "revenue", SPLIT["train_end"])
    return counts.join(fit, "series_id").join(spread, "series_id").select("series_id", "days", "forecasts", (F.col("sigma") < F.col("spread")).alias("below_spread"))
