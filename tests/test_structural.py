"""Sparse structural model: optimality, sparsity, recovery, interval."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import series
from tidecast.operators import structural as su
from tidecast.operators.spine import date_spine

DAYS = 1200


def bent(noise=0.02, seed=2):
    """One slope change at three tenths of the history, a year and a week."""
    i = np.arange(DAYS)
    trend = 1 + 2.0 * i / DAYS - 3.5 * np.maximum(i / DAYS - 0.3, 0)
    return 1000 * (trend * (1 + 0.2 * np.sin(2 * np.pi * i / 365.25) + 0.1 * (i % 7 == 5)) + np.random.default_rng(seed).normal(0, noise, DAYS))


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_gradient_equals_the_pull_of_the_priors(spark, mode):
    params = su.StructuralParams(mode=mode, noise=0.1)
    df = series(spark, "2019-03-01", bent()).unionByName(series(spark, "2019-03-01", bent(0.3, 9), "b"))
    start = time.perf_counter()
    coef = su.structural_fit(df, "revenue", params)
    rows = su.optimality(coef, df, "revenue", params).collect()
    assert time.perf_counter() - start < 60
    for r in rows:
        assert r.trend_violation < 1e-8 and r.season_violation < 1e-8 and 0 < r.changes < params.n_knots


def test_moving_any_coefficient_costs(spark):
    """The objective of the fitted curve is lower than that of curves nearby, and lower than without the sparse prior's solution."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 7))
    y, ridge, lasso = x @ rng.normal(size=7), np.r_[0.5, np.zeros(6)], np.r_[0, 0, 40.0, 40, 40, 40, 0]
    b = su.solve(x.T @ x, x.T @ y, ridge, lasso, np.zeros(7), 1e-9)
    cost = lambda v: ((y - x @ v) ** 2).sum() / 2 + (ridge * v * v).sum() / 2 + (lasso * np.abs(v)).sum()
    assert all(cost(b) <= cost(b + d) + 1e-9 for d in rng.normal(0, 0.05, (500, 7)))
    assert su.violation(x.T @ x + np.diag(ridge), x.T @ y, lasso, b) < 1e-9


def test_change_is_found_where_it_is(spark):
    params = su.StructuralParams(noise=0.05)
    r = su.structural_fit(series(spark, "2019-03-01", bent()), "revenue", params).first()
    change = np.array(r.trend_coef[2:])
    near = [k for k, at in enumerate(params.knots) if abs(at - 0.3) < 0.08]
    assert np.abs(change[near]).sum() > 0.7 * np.abs(change).sum() and change[near].sum() < 0


def test_weaker_prior_bends_more(spark):
    df = series(spark, "2019-03-01", bent(0.2))
    bends = [np.count_nonzero(su.structural_fit(df, "revenue", su.StructuralParams(knot_prior=p)).first().trend_coef[2:]) for p in (1e-4, 0.15, 50.0)]
    assert bends[0] == 0 and bends[0] <= bends[1] <= bends[2] and bends[2] > 3


def test_series_without_history_and_constant_series(spark):
    df = series(spark, "2020-01-01", [5.0] * 400)
    coef = su.structural_fit(df, "revenue")
    days = date_spine(df, end="2021-06-30")
    both = days.unionByName(days.withColumn("series_id", F.lit("new")))
    out = su.structural_predict(coef, both).groupBy("series_id").agg(F.count("structural_pred").alias("n"), F.avg("structural_pred").alias("m")).collect()
    assert {r.series_id: r.n for r in out} == {"a": 547, "new": 0}
    assert next(r.m for r in out if r.series_id == "a") == pytest.approx(5.0, rel=1e-3)


def test_interval_holds_the_curve_and_widens(spark):
    df = series(spark, "2019-03-01", bent(0.05))
    params = su.StructuralParams(noise=0.05)
    coef = su.structural_fit(df, "revenue", params)
    days = date_spine(df, end="2024-06-30")
    one, two = (su.simulated_interval(coef, days.repartition(n), params, draws=200).orderBy("ds").collect() for n in (2, 7))
    assert one == two and len(one) == (np.datetime64("2024-06-30") - np.datetime64("2019-03-01")).astype(int) + 1 - DAYS
    width = np.array([r.upper - r.lower for r in one])
    assert np.mean([r.lower <= r.structural_pred <= r.upper for r in one]) > 0.97
    assert width[-200:].mean() > 1.3 * width[:200].mean()
    std = coef.first().residual_std
    assert width[:20].mean() == pytest.approx(2 * 1.96 * std, rel=0.25)
