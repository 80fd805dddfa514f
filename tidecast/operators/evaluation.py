"""Model assembly and evaluation: hybrid forecasts, backtests, comparison, ablation, search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tidecast.fixed_values import (ALL_FEATURES, BASE_FEATURES, CALENDAR_EXTRA_FEATURES, EXOG_FEATURES)
from tidecast.functions.calendar import promo_flag_by_day_of_year
from tidecast.functions.scalars import pct_change, ratio
from tidecast.operators.arma import arma_forecast
from tidecast.operators.boosting import (SAMPLED_TREES, SHALLOW_TREES, TreeParams, fit_settings, fit_trees, predict_trees)
from tidecast.operators.features import exog_lags, future_safe_features, with_exog
from tidecast.operators.forecasting import (clipped_ratio, cogs_from_ratio, forecast_metrics, metric_columns)
from tidecast.operators.recursive import recursive_forecast
from tidecast.operators.spine import KEYS, date_spine
from tidecast.operators.structural import StructuralParams, structural_fit, structural_predict
from tidecast.operators.windows import lag_days
from tidecast.session import cut_lineage


def between(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Closed date range."""
    return df.where(F.col("ds").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def model_state(panel: DataFrame, exog: DataFrame | None, train_end: str, horizon_end: str, target: str = "revenue",
                params: StructuralParams = StructuralParams(), keys=KEYS) -> DataFrame:
    """Fitted structural model over history and horizon, residuals known up to ``train_end``, drivers attached.

    ``panel``: (keys, ds, revenue, cogs, clean_revenue, clean_cogs).
    """
    coef = structural_fit(panel, f"clean_{target}", params, train_end, keys)
    days = date_spine(panel, keys, end=horizon_end)
    state = structural_predict(coef, days, params, keys)
    if exog is not None:
        state = with_exog(state, exog_lags(exog))
    actual = panel.select(*keys, "ds", F.col(target).alias("actual"))
    known = F.when(F.col("ds") <= F.to_date(F.lit(train_end)), F.col("actual") - F.col("structural_pred"))
    return state.join(actual, [*keys, "ds"], "left").withColumn("residual", known)


def hybrid_features(state: DataFrame, keys=KEYS) -> DataFrame:
    return future_safe_features(state, keys, keep=("actual", "structural_pred", "residual"))


def hybrid_validation(panel: DataFrame, exog: DataFrame | None, split: dict, target: str = "revenue",
                      structural: StructuralParams = StructuralParams(), columns=ALL_FEATURES,
                      boost: TreeParams = SHALLOW_TREES, keys=KEYS) -> DataFrame:
    """(keys, ds, actual, structural_pred, pred) over the validation year: structural model plus residual learner."""
    state = model_state(panel, exog, split["train_end"], split["val_end"], target, structural, keys)
    feats = cut_lineage(hybrid_features(state, keys))
    train = feats.where(F.col("ds") <= F.to_date(F.lit(split["train_end"])))
    trees = fit_trees(train, "residual", columns, boost, keys)
    scored = predict_trees(trees, between(feats, split["val_start"], split["val_end"]), keys)
    return scored.select(*keys, "ds", "actual", "structural_pred",
                         (F.col("structural_pred") + F.col("residual_pred")).alias("pred"))


def full_forecast(panel: DataFrame, exog: DataFrame, split: dict, structural: StructuralParams = StructuralParams(),
                  boost: TreeParams = SHALLOW_TREES, keys=KEYS) -> DataFrame:
    """The whole pipeline: fit, patch the validation year, recurse over the horizon, derive cost from the ratio."""
    state = cut_lineage(model_state(panel, exog, split["train_end"], split["test_end"], "revenue", structural, keys))
    feats = hybrid_features(state, keys)
    train = feats.where(F.col("ds") <= F.to_date(F.lit(split["train_end"])))
    trees = cut_lineage(fit_trees(train, "residual", ALL_FEATURES, boost, keys))
    last_actual = F.date_sub(F.to_date(F.lit(split["test_start"])), 1)
    patched = state.withColumn("residual", F.when(
        F.col("ds") <= last_actual, F.coalesce(F.col("actual") - F.col("structural_pred"), F.col("residual")))
        .otherwise(F.col("residual")))
    fc = recursive_forecast(patched, lambda f: predict_trees(trees, f, keys), split["test_start"], split["test_end"], keys)
    out = cogs_from_ratio(fc.withColumnRenamed("forecast", "revenue_pred"), panel, split["val_end"], keys=keys)
    return out.select(*keys, "ds", F.col("revenue_pred").alias("revenue"), F.col("cogs_pred").alias("cogs"))


# --- folds -------------------------------------------------------------------------------------

def expanding_folds(df: DataFrame, n_splits: int = 3, keys=KEYS) -> DataFrame:
    """Adds ``fold``: 0 for the first training block, k for the k-th test block.

    Test blocks have n // (n_splits + 1) rows and sit at the end; fold k trains on every row of lower folds.
    """
    n = F.count("*").over(W.partitionBy(*keys))
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("ds"))
    size = F.floor(n / (n_splits + 1))
    first = n - size * n_splits
    fold = F.when(pos <= first, 0).otherwise(F.floor(ratio(pos - first - 1, size)) + 1)
    return df.withColumn("fold", fold.cast("int"))


def fold_rows(features: DataFrame, label: str = "residual", n_splits: int = 3, columns=ALL_FEATURES, keys=KEYS) -> DataFrame:
    """Every complete row once per fold that uses it: trains fold k if its block is lower (``held_out`` false), is judged by the fold of its own block."""
    folded = expanding_folds(features.dropna(subset=[*columns, label]), n_splits, keys).withColumnRenamed("fold", "_block")
    return (folded.withColumn("fold", F.explode(F.sequence(F.greatest("_block", F.lit(1)), F.lit(n_splits))))
            .withColumn("held_out", F.col("fold") == F.col("_block")).drop("_block"))


def expanding_cv(features: DataFrame, label: str = "residual", columns=ALL_FEATURES, boost: TreeParams = SAMPLED_TREES,
                 n_splits: int = 3, keys=KEYS) -> DataFrame:
    """Per fold error of the residual learner, plus a ``mean``/``std`` row pair. All folds of all series are fitted in one job."""
    rows = cut_lineage(fold_rows(features, label, n_splits, columns, keys))
    trees = fit_trees(rows.where(~F.col("held_out")), label, columns, boost, ("fold", *keys))
    scored = predict_trees(trees, rows.where("held_out"), ("fold", *keys)).withColumn("fold", F.col("fold").cast("string"))
    per_fold = forecast_metrics(scored, label, "residual_pred", by=("fold",)).select("fold", "mae", "r2")
    per_fold = cut_lineage(per_fold)
    total = per_fold.agg(F.avg("mae").alias("m"), F.stddev_samp("mae").alias("s"), F.avg("r2").alias("mr"),
                         F.stddev_samp("r2").alias("sr"))
    mean = total.select(F.lit("mean").alias("fold"), F.col("m").alias("mae"), F.col("mr").alias("r2"))
    std = total.select(F.lit("std").alias("fold"), F.col("s").alias("mae"), F.col("sr").alias("r2"))
    return per_fold.unionByName(mean).unionByName(std)


def rolling_folds(panel: DataFrame, folds: list[dict], keys=KEYS) -> DataFrame:
    """The panel once per fold, cut at the fold's end, with the fold as one more series key.

    All folds are then fitted side by side by any keyed operator. Columns added: fold, train_end, val_start, val_end.
    """
    table = F.array(*[F.struct(
        F.lit(f["name"]).alias("fold"), *[F.to_date(F.lit(f[k])).alias(k) for k in ("train_end", "val_start", "val_end")])
        for f in folds])
    return (panel.withColumn("_f", F.explode(table)).where(F.col("ds") <= F.col("_f.val_end"))
                 .select("_f.*", *panel.columns))


def backtest_naive(panel: DataFrame, folds: list[dict], target: str = "revenue", keys=KEYS) -> DataFrame:
    """Error of the same-day-last-year forecast per fold, all folds in one plan."""
    rows = rolling_folds(panel, folds, keys)
    scored = rows.withColumn("pred", lag_days(F.col(target), 365, ("fold", *keys)))
    return forecast_metrics(scored.where(F.col("ds").between(F.col("val_start"), F.col("val_end"))),
                            target, "pred", by=("fold", *keys))


def backtest(panel: DataFrame, exog: DataFrame, folds: list[dict], boost: TreeParams = SAMPLED_TREES,
             structural: StructuralParams = StructuralParams(), keys=KEYS) -> DataFrame:
    """Fixed architecture on every fold: (fold, target, errors, improvement over last year's value, % loss days).

    Folds are one more key of the residual models, which are fitted in one job. Only the recursion runs fold by fold, as the years differ; later
    years of a fold read predicted residuals, never actual ones.
    """
    by = ("fold", *keys)
    parts = [model_state(panel.where(F.col("ds") <= f["val_end"]), exog, f["train_end"], f["val_end"], "revenue", structural, keys)
             .withColumn("fold", F.lit(f["name"])) for f in folds]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    states = cut_lineage(states)
    trees = cut_lineage(fit_trees(hybrid_features(states, by), "residual", ALL_FEATURES, boost, by))
    parts = []
    for f in folds:
        own = F.col("fold") == f["name"]
        fc = recursive_forecast(states.where(own), lambda x, m=trees.where(own): predict_trees(m, x, by), f["val_start"], f["val_end"], by)
        fc = cogs_from_ratio(fc.withColumnRenamed("forecast", "revenue_pred"), panel, f["train_end"], keys=keys)
        parts.append(fc.select("fold", *keys, "ds", "revenue_pred", "cogs_pred"))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    naive = panel.select(*keys, "ds", "revenue", "cogs", lag_days(F.col("revenue"), 365, keys).alias("_nr"),
                         lag_days(F.col("cogs"), 365, keys).alias("_nc"))
    joined = preds.join(naive, [*keys, "ds"])
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"{t}_pred").alias("pred"),
                               F.col(n).alias("naive")) for t, n in (("revenue", "_nr"), ("cogs", "_nc"))])
    loss = (F.col("cogs_pred") > F.col("revenue_pred")).cast("int").alias("_loss")
    long = joined.select("fold", loss, F.explode(cells).alias("_c")).select("fold", "_loss", "_c.*")
    both = F.col("naive").isNotNull()
    out = long.groupBy("fold", "target").agg(
        *metric_columns(F.col("y"), F.col("pred")), (F.avg("_loss") * 100).alias("loss_pct"),
        F.avg(F.when(both, F.abs(F.col("y") - F.col("naive")))).alias("naive_mae"),
        F.avg(F.when(both, F.abs(F.col("y") - F.col("pred")))).alias("_own"))
    return out.withColumn("improvement_pct", -pct_change(F.col("_own"), F.col("naive_mae"))).drop("_own")


# --- comparison --------------------------------------------------------------------------------

def comparison_metrics(preds: DataFrame) -> DataFrame:
    """``preds``: (model, ds, revenue, cogs, revenue_pred, cogs_pred) -> one row of metrics per model."""
    r, c, rp, cp = (F.col(x) for x in ("revenue", "cogs", "revenue_pred", "cogs_pred"))
    rev = preds.groupBy("model").agg(*[m.alias(f"rev_{n}") for m, n in zip(
        metric_columns(r, rp), ("n", "mae", "rmse", "r2", "mape"))])
    cost = preds.where(cp.isNotNull() & rp.isNotNull()).groupBy("model").agg(*[m.alias(f"cogs_{n}") for m, n in zip(
        metric_columns(c, cp), ("n", "mae", "rmse", "r2", "mape"))], (F.avg((cp > rp).cast("int")) * 100).alias("loss_pct"))
    return rev.join(cost, "model", "left").select(
        "model", "rev_mae", "rev_rmse", "rev_r2", "rev_mape", "cogs_mae", "cogs_r2", "cogs_mape", "loss_pct")


def ratio_structural(panel: DataFrame, split: dict, structural: StructuralParams, keys=KEYS) -> DataFrame:
    """Cost ratio extrapolated by the structural model: (keys, ds, ratio_pred) over the validation year."""
    history = panel.where(F.col("ds") <= F.to_date(F.lit(split["train_end"]))).withColumn("ratio", clipped_ratio())
    coef = structural_fit(history, "ratio", structural, None, keys)
    days = between(date_spine(panel, keys, end=split["val_end"]), split["val_start"], split["val_end"])
    return structural_predict(coef, days, structural, keys, "ratio_pred", "_trend").drop("_trend")


def architecture_predictions(panel: DataFrame, exog: DataFrame, split: dict, boost: TreeParams = SAMPLED_TREES,
                             shallow: TreeParams = SHALLOW_TREES, keys=KEYS) -> DataFrame:
    """(model, keys, ds, revenue_pred, cogs_pred) of eleven architectures on one split."""
    plain = StructuralParams(mode="additive").without_promos()
    promo = StructuralParams(mode="additive")
    multi = StructuralParams()
    val = lambda df: between(df, split["val_start"], split["val_end"])
    none = F.lit(None).cast("double").alias("cogs_pred")
    cols = [*keys, "ds"]

    def tag(name, df, revenue, cogs=none):
        return df.select(F.lit(name).alias("model"), *cols, F.col(revenue).alias("revenue_pred"), cogs)

    def with_ratio(name, df):
        out = cogs_from_ratio(df.withColumnRenamed("pred", "revenue_pred"), panel, split["train_end"], keys=keys)
        return tag(name, out, "revenue_pred", F.col("cogs_pred"))

    naive = val(panel.select(*cols, lag_days(F.col("revenue"), 365, keys).alias("pred")))
    ar = arma_forecast(panel, "revenue", split["train_end"], split["val_end"], keys=keys)
    only = val(model_state(panel, None, split["train_end"], split["val_end"], "revenue", plain, keys))
    base = hybrid_validation(panel, None, split, "revenue", plain, BASE_FEATURES, boost, keys)
    own_cost = hybrid_validation(panel, None, split, "cogs", plain, BASE_FEATURES, boost, keys)
    own = base.join(own_cost.select(*cols, F.col("pred").alias("_c")), cols)
    via = base.join(ratio_structural(panel, split, plain, keys), cols)
    drivers = BASE_FEATURES + EXOG_FEATURES
    extras = drivers + CALENDAR_EXTRA_FEATURES
    runs = [
        tag("M1.0", naive, "pred"),
        tag("M1.1", val(ar), "pred"),
        tag("M2.0", only, "structural_pred"),
        tag("M2.1", own, "pred", F.col("_c").alias("cogs_pred")),
        tag("M2.2", via, "pred", (F.col("pred") * F.col("ratio_pred")).alias("cogs_pred")),
        with_ratio("M3.0", base),
        with_ratio("M3.1", hybrid_validation(panel, None, split, "revenue", promo, BASE_FEATURES, boost, keys)),
        with_ratio("M3.2", hybrid_validation(panel, exog, split, "revenue", promo, drivers, boost, keys)),
        with_ratio("M3.3", hybrid_validation(panel, exog, split, "revenue", multi, drivers, boost, keys)),
        with_ratio("M3.4", hybrid_validation(panel, exog, split, "revenue", multi, extras, boost, keys)),
        with_ratio("M3.5", hybrid_validation(panel, exog, split, "revenue", multi, (*extras, "resid_lag730"), shallow, keys)),
    ]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def model_comparison(panel: DataFrame, exog: DataFrame, split: dict, boost: TreeParams = SAMPLED_TREES,
                     shallow: TreeParams = SHALLOW_TREES, keys=KEYS) -> DataFrame:
    preds = architecture_predictions(panel, exog, split, boost, shallow, keys)
    return comparison_metrics(preds.join(panel.select(*keys, "ds", "revenue", "cogs"), [*keys, "ds"]))


# --- ablation and search -----------------------------------------------------------------------

#: Candidates outside the feature matrix.
REJECTED_FEATURES = ("is_promo_lag365", "is_promo_lag730", "is_odd_year")


def candidate_sets() -> dict[str, tuple[str, ...]]:
    """What is added to the base features: nothing, each driver or rejected candidate alone, traffic with overstock, all drivers."""
    alone = {name: (name,) for name in (*EXOG_FEATURES, *REJECTED_FEATURES)}
    pair = ("sessions_lag365", "overstock_pct_lag365")
    return {"base": (), **alone, " and ".join(pair): pair, "all drivers": EXOG_FEATURES}


def ablation_features(state: DataFrame, keys=KEYS) -> DataFrame:
    """The feature matrix plus the rejected candidates: promotion flag lags and odd-year flag."""
    flagged = state.withColumn("is_promo", promo_flag_by_day_of_year(F.col("ds")))
    lags = [lag_days(F.col("is_promo"), n, keys).alias(f"is_promo_lag{n}") for n in (365, 730)]
    extra = flagged.select(*flagged.columns, *lags, F.pmod(F.year("ds"), F.lit(2)).alias("is_odd_year"))
    keep = ("actual", "structural_pred", "residual", *REJECTED_FEATURES)
    return future_safe_features(extra, keys, keep=keep)


def feature_ablation(features: DataFrame, split: dict, sets: dict | None = None, boost: TreeParams = SAMPLED_TREES, keys=KEYS) -> DataFrame:
    """Validation error of each feature set against the base set; keep at −0.5 % or better, drop above +0.5 %. All sets are fitted in one job."""
    sets = sets or candidate_sets()
    features = cut_lineage(features)
    train = features.where(F.col("ds") <= F.to_date(F.lit(split["train_end"])))
    trees = fit_settings(train, "residual", {name: ((*BASE_FEATURES, *extra), boost) for name, extra in sets.items()}, keys)
    val = between(features, split["val_start"], split["val_end"]).withColumn("setting", F.explode(F.array(*map(F.lit, sets))))
    scored = predict_trees(trees, val, ("setting", *keys))
    rows = scored.select(F.col("setting").alias("config"), F.col("actual").alias("y"), (F.col("structural_pred") + F.col("residual_pred")).alias("pred"))
    m = cut_lineage(forecast_metrics(rows, by=("config",)).select("config", "mae", "r2"))
    base = m.where(F.col("config") == next(iter(sets))).select(F.col("mae").alias("_base"))
    out = m.crossJoin(F.broadcast(base)).withColumn("delta_mae_pct", pct_change(F.col("mae"), F.col("_base"))).drop("_base")
    delta = F.col("delta_mae_pct")
    return out.withColumn("verdict", F.when(delta <= -0.5, "keep").when(delta > 0.5, "drop").otherwise("neutral"))


#: Axes of the search: (lowest, highest, on a logarithmic scale, whole numbers). Depth stands for the depth and the number of leaves of a tree.
SEARCH_AXES = {"step": (0.01, 0.1, True, False), "depth": (3, 6, False, True), "min_leaf": (10, 60, False, True), "row_share": (0.6, 1.0, False, False),
               "column_share": (0.6, 1.0, False, False), "l1": (1e-3, 10.0, True, False), "l2": (1e-3, 10.0, True, False)}
#: Rungs of the search: new trials and the rounds every trial of the rung may use.
RUNGS = ((20, 120), (15, 350), (15, 1000))
SURVIVORS = 1 / 3


def trial_params(point: np.ndarray, rounds: int, patience: int = 50, seed: int = 42) -> TreeParams:
    """Parameters at a point of the unit cube, one coordinate per axis."""
    chosen = {}
    for u, (name, (low, high, logarithmic, whole)) in zip(point, SEARCH_AXES.items()):
        value = low * (high / low) ** u if logarithmic else low + (high - low) * u
        chosen[name] = min(high, int(low + (high - low + 1) * u)) if whole else round(float(value), 6)
    return TreeParams(rounds=rounds, patience=patience, seed=seed, bins=64, **chosen)


def propose(points: np.ndarray, losses: np.ndarray, rng: np.random.Generator, candidates: int = 24, best_share: float = 0.25) -> np.ndarray:
    """The candidate with the greatest ratio of the density of good trials to that of the others, per-axis normal kernels around each trial."""
    order = np.argsort(losses, kind="stable")
    n = max(2, round(len(points) * best_share))
    good, rest = points[order[:n]], points[order[n:]]
    width = lambda p: np.clip(p.std(0) * len(p) ** -0.2, 0.05, 0.5)

    def log_density(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        k = np.exp(-((x[:, None, :] - p[None]) / width(p)) ** 2 / 2) / width(p)
        return np.log(k.mean(1) + 1e-12).sum(1)

    drawn = good[rng.integers(0, n, candidates)] + rng.normal(size=(candidates, points.shape[1])) * width(good)
    drawn = 1 - np.abs(1 - np.abs(drawn) % 2)        # reflected at the faces of the cube
    return drawn[np.argmax(log_density(drawn, good) - log_density(drawn, rest))]


def param_search(features: DataFrame, label: str = "residual", columns=ALL_FEATURES, rungs=RUNGS, n_splits: int = 3, seed: int = 42, keys=KEYS) -> DataFrame:
    """Successive halving over expanding folds, best trial first: (trial, rung, rounds, trees, cv_mae, parameters).

    The first rung draws its trials evenly. Later rungs keep the best ``SURVIVORS`` of the rung before and add trials where good ones are dense. Every trial stops early on the mean
    absolute error of each fold's test block. A rung is one Spark job with a model per (trial, fold, series); only one mean per trial comes back. ``rung``, ``rounds`` and ``trees`` tell how far a
    trial went: its allowed rounds and the trees it kept over all folds.
    """
    spark = features.sparkSession
    rows = cut_lineage(fold_rows(features, label, n_splits, columns, keys))
    rng = np.random.default_rng(seed)
    points, reached, alive = [], {}, []
    for rung, (new, rounds) in enumerate(rungs, 1):
        known = sorted(reached)
        for _ in range(new):
            points.append(rng.random(len(SEARCH_AXES)) if not known else propose(
                np.array([points[t] for t in known]), np.array([-reached[t]["rung"] * 1e12 + reached[t]["cv_mae"] for t in known]), rng))
        alive += range(len(points) - new, len(points))
        settings = {str(t): (tuple(columns), trial_params(points[t], rounds, seed=seed)) for t in alive}
        trees = fit_settings(rows, label, settings, ("fold", *keys), "held_out")
        folds = trees.groupBy("setting", "fold", *keys).agg(F.count("*").alias("trees"), F.max("held_out_mae").alias("mae"))
        means = folds.groupBy("setting").agg(F.sum("trees").alias("trees"), F.avg("mae").alias("cv_mae"))
        for r in means.collect():
            reached[int(r["setting"])] = {"rung": rung, "rounds": rounds, "trees": r["trees"], "cv_mae": r["cv_mae"]}
        alive = sorted((t for t in alive if t in reached), key=lambda t: (reached[t]["cv_mae"], t))[:max(1, round(len(alive) * SURVIVORS))]
    out = [(t, r["rung"], r["rounds"], r["trees"], r["cv_mae"], *(getattr(trial_params(points[t], r["rounds"]), a) for a in SEARCH_AXES))
           for t, r in sorted(reached.items(), key=lambda e: (-e[1]["rung"], e[1]["cv_mae"], e[0]))]
    kinds = ", ".join(f"{a} {'int' if whole else 'double'}" for a, (_, _, _, whole) in SEARCH_AXES.items())
    return spark.createDataFrame(out, f"trial int, rung int, rounds int, trees bigint, cv_mae double, {kinds}")
