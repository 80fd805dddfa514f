"""Autoregression with moving averages, automatic cointegration test and robust decomposition against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import series
from tidecast.operators import arma, smoothing as sm, stats as st


# --- autoregression with moving average ------------------------------------------------------------

def simulated(n=4000, phi=(0.5, -0.3), theta=(0.6,), seed=1):
    rng = np.random.default_rng(seed)
    d, e = np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        d[t] = phi[0] * d[t - 1] + phi[1] * d[t - 2] + e[t] + theta[0] * e[t - 1]
    return d


def test_known_coefficients_are_recovered():
    phi, theta = arma.fit_arma(simulated(), arma.ArmaOrder(2, 1, 1))
    assert phi == pytest.approx([0.5, -0.3], abs=0.06) and theta == pytest.approx([0.6], abs=0.06)


def test_moving_average_lowers_the_error():
    d = simulated(seed=4)
    with_ma = arma.shocks_of(d, *arma.fit_arma(d, arma.ArmaOrder(1, 1, 1)))
    without = arma.shocks_of(d, *arma.fit_arma(d, arma.ArmaOrder(1, 1, 0)))
    assert np.var(with_ma) < np.var(without)


def test_one_step_errors_by_hand(spark):
    rng = np.random.default_rng(3)
    y = 100 + np.cumsum(rng.normal(size=400))
    df = series(spark, "2020-01-01", y)
    r = arma.arma_coefficients(df, "revenue", "2030-01-01").first()
    d, e = np.diff(y), []
    for t in range(len(d)):
        e.append(d[t] - sum(r.phi[k] * d[t - 1 - k] for k in range(5) if t > k) - sum(r.theta[k] * e[t - 1 - k] for k in range(2) if t > k))
    assert r.sigma == pytest.approx(np.std(e)) and r.n == 400
    got = [x.pred for x in arma.arma_forecast(df, "revenue", "2030-01-01", "2021-02-10").orderBy("ds").collect()]
    level, dd, ee = y[-1], list(d), list(e)
    for value in got:
        step = sum(r.phi[k] * dd[-1 - k] for k in range(5)) + sum(r.theta[k] * ee[-1 - k] for k in range(2))
        level, dd, ee = level + step, dd + [step], ee + [0.0]
        assert value == pytest.approx(level)
    assert len(got) == 7


def test_short_constant_and_finished_series(spark):
    short = series(spark, "2020-01-01", [1.0, 4.0, 2.0], "short")
    flat = series(spark, "2020-01-01", [3.0] * 200, "flat")
    out = arma.arma_forecast(short.unionByName(flat), "revenue", "2030-01-01", "2020-07-20").groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi")).collect()
    assert {r.series_id: (r.n, r.lo, r.hi) for r in out} == {"short": (199, 2.0, 2.0), "flat": (2, 3.0, 3.0)}


# --- cointegration -------------------------------------------------------------------------------------

def brute_unit_root(e):
    n, d = len(e), np.diff(e)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 1)

    def regress(lag, skip):
        y = d[skip:]
        x = np.column_stack([e[skip:-1], *(d[skip - k:len(d) - k] for k in range(1, lag + 1))])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return x, y, b, ((y - x @ b) ** 2).sum()

    scores = []
    for lag in range(most + 1):
        x, y, _, rss = regress(lag, most)
        scores.append(len(y) * (np.log(2 * np.pi * rss / len(y)) + 1) + 2 * (lag + 1))
    lag = int(np.argmin(scores))
    x, y, b, rss = regress(lag, lag)
    return lag, len(y), b[0] / np.sqrt(rss / (len(y) - lag - 1) * np.linalg.inv(x.T @ x)[0, 0])


@pytest.mark.parametrize("seed", range(4))
def test_lag_and_statistic_equal_separate_regressions(seed):
    rng = np.random.default_rng(seed)
    e = np.zeros(500)
    for t in range(3, 500):
        e[t] = 0.7 * e[t - 1] + 0.2 * e[t - 3] + rng.normal()
    lag, n, t = st.unit_root(e)
    want = brute_unit_root(e)
    assert (lag, n) == want[:2] and t == pytest.approx(want[2], rel=1e-8)


def test_related_and_unrelated_series(spark):
    rng = np.random.default_rng(8)
    walk, other = 500 + np.cumsum(rng.normal(size=900)), 500 + np.cumsum(rng.normal(size=900))
    df = series(spark, "2018-01-01", walk).withColumn("cogs", F.col("revenue") * 0.7)
    noisy = series(spark, "2018-01-01", 0.7 * walk + rng.normal(size=900), col="cogs")
    apart = series(spark, "2018-01-01", other, col="cogs")
    both = (df.drop("cogs").join(noisy, ["series_id", "ds"]).unionByName(df.drop("cogs").join(apart, ["series_id", "ds"]).withColumn("series_id", F.lit("b")))
            .unionByName(df.withColumn("series_id", F.lit("same"))))
    got = {r.series_id: r for r in st.cointegration_auto(both).collect()}
    assert got["a"].is_cointegrated and got["a"].p_value < 1e-6 and not got["b"].is_cointegrated and got["b"].p_value > 0.05
    assert got["same"].t_stat is None and got["same"].p_value is None


def test_response_surface_at_published_points():
    for level, t in ((0.01, -3.89644), (0.05, -3.33613), (0.10, -3.04445)):
        assert st.surface_p(t) == pytest.approx(level, abs=0.002)
    grid = [st.surface_p(t) for t in np.linspace(-20, 2, 400)]
    assert grid[0] == 0 and grid[-1] == 1 and all(b >= a - 1e-3 for a, b in zip(grid, grid[1:]))


# --- decomposition -----------------------------------------------------------------------------------------

def brute_line(y, weight, window, at):
    gap = np.abs(np.arange(len(y)) - at)
    near = np.argsort(gap, kind="stable")[:min(window, len(y))]
    w = np.zeros(len(y))
    w[near] = (np.clip(1 - (gap / (gap[near].max() + max(0, window - len(y)) // 2)) ** 3, 0, 1) ** 3 * weight)[near]
    x = np.column_stack([np.ones(len(y)), np.arange(len(y)) - at])
    return np.linalg.lstsq(np.sqrt(w)[:, None] * x, np.sqrt(w) * y, rcond=None)[0][0]


@pytest.mark.parametrize("window, at", [(13, None), (31, None), (7, np.arange(-1, 61))])
def test_local_line_equals_weighted_regression(window, at):
    rng = np.random.default_rng(5)
    y, weight = rng.normal(size=60), rng.random(60) + 0.05
    got = sm.local_line(y, weight, window, at)
    assert got == pytest.approx([brute_line(y, weight, window, x) for x in (np.arange(60) if at is None else at)])
    two = sm.local_line(np.vstack([y, 2 * y]), np.vstack([weight, weight]), window, at)
    assert two[1] == pytest.approx(2 * got)


def yearly(n=6 * 52, seed=0):
    i = np.arange(n)
    return 100 + 0.05 * i, 20 * np.sin(2 * np.pi * i / 52), np.random.default_rng(seed).normal(0, 1, n)


def test_outlier_day_moves_neither_season_nor_trend(spark):
    trend, season, noise = yearly()
    y = trend + season + noise
    spiked = y.copy()
    spiked[130] += 400
    df = series(spark, "2020-01-01", y).unionByName(series(spark, "2020-01-01", spiked, "b"))
    got = {r.series_id: {} for r in df.select("series_id").distinct().collect()}
    for r in sm.robust_decompose(df, "revenue", 52).collect():
        got[r.series_id][r.ds] = r
    a, b = ([got[s][d] for d in sorted(got[s])] for s in "ab")
    assert b[130].weight == 0 and b[130].residual > 390
    assert max(abs(x.trend - z.trend) for x, z in zip(a, b)) < 0.2 and max(abs(x.seasonal - z.seasonal) for x, z in zip(a, b)) < 3
    assert np.mean([abs(x.seasonal - s) for x, s in zip(a, season)]) < 1 and np.mean([abs(x.trend - t) for x, t in zip(a, trend)]) < 0.5
    assert all(x.trend + x.seasonal + x.residual == pytest.approx(v) for x, v in zip(a, y))


def test_short_series_has_no_parts(spark):
    out = sm.robust_decompose(series(spark, "2020-01-01", [1.0] * 90), "revenue", 52).collect()
    assert len(out) == 90 and {r.trend for r in out} == {None}
    flat = sm.robust_decompose(series(spark, "2020-01-01", [1.0] * 120), "revenue", 52).collect()
    assert all(r.trend == pytest.approx(1) and r.seasonal == pytest.approx(0, abs=1e-9) for r in flat)
