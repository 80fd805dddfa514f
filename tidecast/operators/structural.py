"""Structural model: piecewise-linear trend with sparse changes, yearly and weekly seasonality, events.

The most probable curve under these priors: an absolute-value (Laplace) prior on the change of slope at each knot, so most changes are exactly zero, and normal priors on
seasonality and events. The additive form is one penalised least-squares problem; the multiplicative form trend × (1 + season) is bilinear and alternates its two halves until neither
moves. Each half is solved on its Gram matrix, absolute-value terms by following signs. A series has one row per calendar day, so its
fit is one bounded group; Spark computes the event flags before it, and prediction, optimality check and interval after it.

``optimality`` recomputes the gradient of the fitted curve from the rows, in the JVM: at the optimum it equals the pull of the priors.
The interval simulates future trend changes as frequent and as large as the past ones (Laplace steps), plus the residual deviation.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidecast.fixed_values import EVENTS
from tidecast.functions.calendar import day_number, event_flag
from tidecast.operators.spine import KEYS

PERIODS = (365.25, 7.0)


@dataclass(frozen=True)
class StructuralParams:
    mode: str = "multiplicative"          # or "additive"
    events: tuple[str, ...] = EVENTS
    n_knots: int = 25
    knot_range: float = 0.9               # knots lie in the first 90 % of the history
    yearly_order: int = 10
    weekly_order: int = 3
    knot_prior: float = 0.15              # scale of the Laplace prior of slope changes
    season_prior: float = 10.0            # deviation of the normal prior of seasonality and events
    noise: float = 0.2                    # residual scale relative to the series maximum
    tolerance: float = 1e-9               # largest violation of the optimality conditions, relative to the squared values
    max_passes: int = 2000

    def without_promos(self) -> "StructuralParams":
        kept = tuple(e for e in self.events if not e.startswith("promo_"))
        return StructuralParams(**{**self.__dict__, "events": kept})

    @property
    def knots(self) -> list[float]:
        return [self.knot_range * (k + 1) / self.n_knots for k in range(self.n_knots)]

    @property
    def waves(self) -> list[float]:
        """Angle per day of every sine and cosine pair."""
        return [2 * pi * n / p for p, order in zip(PERIODS, (self.yearly_order, self.weekly_order)) for n in range(1, order + 1)]

    @property
    def change_penalty(self) -> float:
        return self.noise ** 2 / self.knot_prior

    @property
    def season_penalty(self) -> float:
        return (self.noise / self.season_prior) ** 2


# --- one series, in a task -------------------------------------------------------------------------

def solve(gram: np.ndarray, target: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, start: np.ndarray, tolerance: float) -> np.ndarray:
    """Minimum of b'Gb / 2 − c'b + Σ ridge b² / 2 + Σ lasso |b|, by signs.

    With the signs of the absolute-value terms fixed, the rest is a linear system. A step goes towards its solution, to the best of the places where a coefficient turns zero on
    the way; where all signs hold, the zero coefficient that the gradient pulls hardest joins. Every step lowers the objective, so no set of signs comes twice.
    """
    full, b, free = gram + np.diag(ridge) + 1e-12 * np.eye(len(target)), start.copy(), lasso == 0
    cost = lambda v: v @ full @ v / 2 - target @ v + lasso @ np.abs(v)
    sign = np.sign(b) * ~free
    while True:
        active = free | (sign != 0)
        aim = np.zeros_like(b)
        aim[active] = np.linalg.solve(full[np.ix_(active, active)], (target - lasso * sign)[active])
        held = ~(active & ~free & (aim * sign < 0)).any()
        if not held:
            crossing = [b[k] / (b[k] - aim[k]) for k in np.flatnonzero(active & ~free & (b * aim < 0))]
            tried = [b + s * (aim - b) for s in [*crossing, 1.0]]
            aim = min(tried, key=cost)
            if cost(aim) >= cost(b):                       # a coefficient that just joined cannot move: leave it out
                return np.where(np.abs(b) < 1e-12, 0.0, b) * (active | free)
            aim[~free & (np.abs(aim) < 1e-12)] = 0.0
        b = aim
        sign = np.sign(b) * ~free
        if held:
            pull = target - full @ b
            excess = np.where((b == 0) & ~free, np.abs(pull) - lasso, 0.0)
            k = int(excess.argmax())
            if excess[k] <= tolerance:
                return b
            sign[k] = np.sign(pull[k])


def violation(full: np.ndarray, target: np.ndarray, lasso: np.ndarray, b: np.ndarray) -> float:
    """How far the gradient is from what the absolute-value terms allow, at most over all coefficients."""
    pull = target - full @ b
    return float(np.where(b == 0, np.maximum(np.abs(pull) - lasso, 0.0), np.abs(pull - lasso * np.sign(b))).max())


def fit_curve(trend_x: np.ndarray, season_x: np.ndarray, y: np.ndarray, params: StructuralParams) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of both halves for one series, on values scaled to a maximum of one."""
    n_trend, n_season = trend_x.shape[1], season_x.shape[1]
    lasso = np.r_[0.0, 0.0, np.full(n_trend - 2, params.change_penalty)]
    ridge = np.full(n_season, params.season_penalty)
    limit = params.tolerance * len(y)
    if params.mode == "additive":
        x = np.hstack([trend_x, season_x])
        both = solve(x.T @ x, x.T @ y, np.r_[np.zeros(n_trend), ridge], np.r_[lasso, np.zeros(n_season)], np.zeros(x.shape[1]), limit)
        return both[:n_trend], both[n_trend:]
    trend, season = np.zeros(n_trend), np.zeros(n_season)
    for _ in range(params.max_passes):
        x = trend_x * (1.0 + season_x @ season)[:, None]
        gram, target = x.T @ x, x.T @ y
        if trend.any() and violation(gram, target, lasso, trend) <= limit:
            break
        trend = solve(gram, target, np.zeros(n_trend), lasso, trend, limit / 10)
        level = trend_x @ trend
        x = season_x * level[:, None]
        season = solve(x.T @ x, x.T @ (y - level), ridge, np.zeros(n_season), season, limit / 10)
    return trend, season


def structural_fit(df: DataFrame, col: str, params: StructuralParams = StructuralParams(), train_end: str | None = None,
                   keys=KEYS) -> DataFrame:
    """One row of coefficients per series: (keys, t_start, t_end, scale, residual_std, trend_coef, season_coef).

    Only (keys, ds, y) and the event flags cross the exchange; the design is built behind it.
    """
    rows = df.where(F.col(col).isNotNull())
    if train_end is not None:
        rows = rows.where(F.col("ds") <= F.to_date(F.lit(train_end)))
    flags = [event_flag(F.col("ds"), e).cast("double").alias(f"_e{k}") for k, e in enumerate(params.events)]
    rows = rows.select(*keys, day_number(F.col("ds")).alias("_day"), F.col(col).cast("double").alias("_y"), *flags)
    double = T.DoubleType()
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("t_start", T.DateType()), T.StructField("t_end", T.DateType()), T.StructField("scale", double),
                           T.StructField("residual_std", double), T.StructField("trend_coef", T.ArrayType(double)), T.StructField("season_coef", T.ArrayType(double))])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_day")
        day, y = table.column("_day").to_numpy().astype(float), table.column("_y").to_numpy()
        t = (day - day[0]) / max(day[-1] - day[0], 1.0)
        trend_x = np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in params.knots]])
        season_x = np.column_stack([f(day * w) for w in params.waves for f in (np.sin, np.cos)] + [table.column(f"_e{k}").to_numpy() for k in range(len(params.events))])
        scale = float(np.abs(y).max()) or 1.0
        trend, season = fit_curve(trend_x, season_x, y / scale, params)
        level = trend_x @ trend
        curve = level + season_x @ season if params.mode == "additive" else level * (1 + season_x @ season)
        columns = [*([k.as_py()] for k in key), [int(day[0])], [int(day[-1])], [scale], [float(np.std(y - curve * scale))], [trend.tolist()], [season.tolist()]]
        kinds = [*(table.schema.field(k).type for k in keys), pa.date32(), pa.date32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], schema.names)

    return rows.repartition(*keys).groupBy(*keys).applyInArrow(fit, schema)


# --- columns -----------------------------------------------------------------------------------------

def scaled_time(ds: Column, start: Column, end: Column) -> Column:
    return F.datediff(ds, start) / F.greatest(F.datediff(end, start), F.lit(1))


def trend_terms(t: Column, params: StructuralParams) -> list[Column]:
    """Intercept, slope, and one hinge per knot, for time scaled to 0…1 over the history."""
    return [F.lit(1.0), t, *[F.greatest(t - knot, F.lit(0.0)) for knot in params.knots]]


def season_terms(ds: Column, params: StructuralParams) -> list[Column]:
    """Fourier terms and event flags of a day."""
    day = day_number(ds)
    return [f(day * w) for w in params.waves for f in (F.sin, F.cos)] + [event_flag(ds, e).cast("double") for e in params.events]


def _dot(terms: list[Column], coef: str) -> Column:
    """Unrolled, so that it stays in generated code."""
    return sum((F.col(coef)[k] * term for k, term in enumerate(terms)), F.lit(0.0))


def _curve(params: StructuralParams) -> Column:
    return F.col("_level") + F.col("_season") if params.mode == "additive" else F.col("_level") * (1 + F.col("_season"))


def _halves(coef: DataFrame, days: DataFrame, params: StructuralParams, keys) -> DataFrame:
    joined = days.join(coef, list(keys), "left")
    t = scaled_time(F.col("ds"), F.col("t_start"), F.col("t_end"))
    return joined.withColumn("_level", _dot(trend_terms(t, params), "trend_coef")).withColumn("_season", _dot(season_terms(F.col("ds"), params), "season_coef"))


def structural_predict(coef: DataFrame, days: DataFrame, params: StructuralParams = StructuralParams(), keys=KEYS,
                       pred: str = "structural_pred", trend: str = "structural_trend") -> DataFrame:
    """Adds prediction and trend to a table of (keys, ds, …); evaluated in the JVM, one unrolled sum per half.

    A series without coefficients keeps its days with NULL predictions.
    """
    out = _halves(coef, days, params, keys)
    return out.select(*days.columns, (_curve(params) * F.col("scale")).alias(pred), (F.col("_level") * F.col("scale")).alias(trend))


def optimality(coef: DataFrame, df: DataFrame, col: str, params: StructuralParams = StructuralParams(), train_end: str | None = None, keys=KEYS) -> DataFrame:
    """(keys, changes, trend_violation, season_violation): knots with a change, and how far the gradient is from the pull of the priors, per day.

    The gradient of every coefficient is a sum over the rows, grouped by (series, coefficient); nothing of the fit is reused but the coefficients.
    """
    rows = df.where(F.col(col).isNotNull()).select(*keys, "ds", F.col(col).cast("double").alias("_y"))
    if train_end is not None:
        rows = rows.where(F.col("ds") <= F.to_date(F.lit(train_end)))
    out = _halves(coef, rows, params, keys).withColumn("_r", F.col("_y") / F.col("scale") - _curve(params))
    t = scaled_time(F.col("ds"), F.col("t_start"), F.col("t_end"))
    lift, level = (F.lit(1.0), F.lit(1.0)) if params.mode == "additive" else (1 + F.col("_season"), F.col("_level"))
    pulls = [("trend", k, F.col("trend_coef")[k], x * lift) for k, x in enumerate(trend_terms(t, params))]
    pulls += [("season", k, F.col("season_coef")[k], x * level) for k, x in enumerate(season_terms(F.col("ds"), params))]
    cells = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(k).alias("k"), b.alias("b"), (x * F.col("_r")).alias("g")) for h, k, b, x in pulls])
    sums = (out.select(*keys, F.explode(cells).alias("_c")).groupBy(*keys, F.col("_c.half").alias("half"), F.col("_c.k").alias("k"))
            .agg(F.sum("_c.g").alias("g"), F.max("_c.b").alias("b"), F.count("*").alias("n")))
    b, g = F.col("b"), F.col("g")
    sparse = (F.col("half") == "trend") & (F.col("k") >= 2)
    miss = (F.when(sparse & (b == 0), F.greatest(F.abs(g) - params.change_penalty, F.lit(0.0)))
            .when(sparse, F.abs(g - params.change_penalty * F.signum(b))).when(F.col("half") == "trend", F.abs(g))
            .otherwise(F.abs(g - params.season_penalty * b))) / F.col("n")
    worst = lambda half: F.max(F.when(F.col("half") == half, miss)).alias(f"{half}_violation")
    return sums.groupBy(*keys).agg(F.count_if(sparse & (b != 0)).alias("changes"), worst("trend"), worst("season"))


def even_draw(*parts: Column) -> Column:
    """An even number between 0 and 1 (exclusive) that depends on the values alone, so reruns and replayed tasks agree."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def simulated_interval(coef: DataFrame, days: DataFrame, params: StructuralParams = StructuralParams(), draws: int = 300, width: float = 0.95, seed: int = 42,
                       keys=KEYS) -> DataFrame:
    """(keys, ds, structural_pred, lower, upper) for days from the end of the history on.

    A draw changes its slope on a day with the frequency of the knots, by a Laplace step of the mean absolute change of the history; running sums per draw give slope and
    level. Noise is normal with the residual deviation. Bounds are quantiles over the draws of a day.
    """
    base = _halves(coef, days, params, keys).where(F.col("ds") > F.col("t_end"))
    span = F.greatest(F.datediff("t_end", "t_start"), F.lit(1))
    change = F.slice("trend_coef", 3, params.n_knots)
    size = F.aggregate(change, F.lit(0.0), lambda a, x: a + F.abs(x)) / params.n_knots
    base = base.select(*keys, "ds", "_level", "_season", "scale", "residual_std", span.alias("_span"), size.alias("_size"),
                       F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    draw = lambda tag: even_draw(*keys, F.col("ds"), F.col("_draw"), F.lit(tag), F.lit(seed))
    half = draw("size") - 0.5
    step = F.when(draw("when") < params.n_knots / F.col("_span"), -F.col("_size") * F.signum(half) * F.log(1 - 2 * F.abs(half))).otherwise(0.0)
    path = W.partitionBy(*keys, "_draw").orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
    moved = base.withColumn("_step", step).withColumn("_slope", F.sum("_step").over(path))
    moved = moved.withColumn("_level", F.col("_level") + F.sum(F.col("_slope") / F.col("_span")).over(path))
    noise = F.sqrt(-2 * F.log(draw("far"))) * F.cos(2 * pi * draw("angle")) * F.col("residual_std")
    value = _curve(params) * F.col("scale") + noise
    tails = F.percentile("_v", F.array(F.lit((1 - width) / 2), F.lit((1 + width) / 2)))
    bounds = moved.withColumn("_v", value).groupBy(*keys, "ds").agg(tails.alias("_q"))
    pred = structural_predict(coef, days, params, keys).select(*keys, "ds", "structural_pred")
    return bounds.join(pred, [*keys, "ds"]).select(*keys, "ds", "structural_pred", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))
