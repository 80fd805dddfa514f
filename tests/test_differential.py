"""Spark operators against pandas one-liners on random series, and invariances."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from tests.conftest import day, series
from tidecast.operators import aggregates as ag, baselines as bl, denoise as dn, spine as sp, stats as st, windows as wn
from tidecast.operators.ranks import histogram_quantiles, histogram_ranks, ranged
from tidecast.operators.structural import StructuralParams, structural_fit, structural_predict

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def noisy(spark):
    values = list(np.round(RNG.gamma(2.0, 50.0, 900), 2))
    for i in RNG.choice(np.arange(1, 899), 60, replace=False):
        values[i] = ...
    df = series(spark, "2018-01-01", values)
    pdf = df.toPandas().assign(ds=lambda d: pd.to_datetime(d["ds"])).set_index("ds").sort_index()["revenue"]
    return df, pdf.reindex(pd.date_range(pdf.index.min(), pdf.index.max()))


def by_day(df, col):
    out = df.select("ds", col).toPandas()
    return out.assign(ds=pd.to_datetime(out["ds"])).set_index("ds").sort_index()[col].astype(float)


def same(a, b):
    pd.testing.assert_series_equal(a, b.astype(float), check_names=False, check_freq=False, rtol=1e-9)


def test_interpolation(noisy):
    df, pdf = noisy
    same(by_day(sp.interpolate_time(sp.fill_gaps(df), ["revenue"]), "revenue"), pdf.interpolate(method="time"))


@pytest.mark.parametrize("before,after,window,center,k,fn", [
    (15, 14, 30, True, 7, "mean"), (15, 14, 30, True, 7, "std"), (89, 0, 90, False, 90, "mean"), (13, 0, 14, False, 14, "std")])
def test_rolling(noisy, before, after, window, center, k, fn):
    df, pdf = noisy
    got = wn.rolling(sp.interpolate_time(sp.fill_gaps(df), ["revenue"]), "revenue", before, after, fn, k, "m")
    same(by_day(got, "m"), getattr(pdf.interpolate(method="time").rolling(window, center=center, min_periods=k), fn)())


def test_rolling_over_missing_values(noisy):
    df, pdf = noisy
    got = wn.rolling(sp.fill_gaps(df), "revenue", 15, 14, "mean", 7, "m")
    same(by_day(got, "m"), pdf.rolling(30, center=True, min_periods=7).mean())


def test_lags_and_lagged_mean(noisy):
    df, pdf = noisy
    dense = sp.fill_gaps(df)
    for n in (364, 365, 366, 730):
        same(by_day(wn.lag_calendar(dense, ["revenue"], n), f"revenue_lag{n}"), pdf.shift(n))
    got = dense.select("ds", wn.lagged_mean(F.col("revenue"), 365, 28).alias("m"))
    same(by_day(got, "m"), pdf.shift(365).rolling(28, min_periods=1).mean())


def test_recurring_spikes_and_cap(noisy):
    df, pdf = noisy
    pdf = pdf.interpolate(method="time")
    filled = sp.interpolate_time(sp.fill_gaps(df), ["revenue"])
    z = pdf.groupby(pdf.index.year).transform(lambda s: (s - s.mean()) / s.std())
    rate = (z > 2.0).groupby([pdf.index.month, pdf.index.day]).transform("mean")
    upper = pdf.rolling(30, center=True, min_periods=7).mean() + 3 * pdf.rolling(30, center=True, min_periods=7).std()
    want = pdf.where(~((pdf > upper) & (rate < 0.7)), upper)
    same(by_day(dn.cap_outliers(filled, "revenue"), "clean_revenue"), want)


def test_baseline_over_unflagged_rows(noisy):
    df, pdf = noisy
    pdf = pdf.interpolate(method="time")
    flag = pd.Series((np.arange(len(pdf)) // 40) % 3 == 1, index=pdf.index)
    filled = sp.interpolate_time(sp.fill_gaps(df), ["revenue"])
    start = F.to_date(F.lit("2018-01-01"))
    offset = (pdf.index[0] - pd.Timestamp("2018-01-01")).days
    flagged = filled.withColumn("is_promo", F.when(F.pmod(F.floor((F.datediff("ds", start) - offset) / 40), F.lit(3)) == 1, 1).otherwise(0))
    want = pdf[~flag].rolling(30).mean().reindex(pdf.index).ffill()
    same(by_day(wn.baseline_outside(flagged, "revenue", "is_promo"), "baseline"), want)


def test_spearman_against_pandas(spark):
    x, y = RNG.integers(0, 20, 300), RNG.integers(0, 20, 300)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g STRING, x DOUBLE, y DOUBLE")
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert st.spearman(df, "x", "y", ["g"]).collect()[0]["r"] == pytest.approx(want, abs=1e-12)


def test_ccf_against_pandas(noisy):
    df, pdf = noisy
    pdf = pdf.interpolate(method="time")
    other = pdf.shift(3).bfill() + np.arange(len(pdf)) % 7
    spark = df.sparkSession
    rows = [("a", d.date(), float(v), float(w)) for d, v, w in zip(pdf.index, pdf, other)]
    both = spark.createDataFrame(rows, "series_id STRING, ds DATE, x DOUBLE, y DOUBLE")
    got = {r["lag"]: r["corr"] for r in st.cross_correlation(both, "x", "y").collect()}
    for k in (-14, -1, 0, 3, 14):
        assert got[k] == pytest.approx(pdf.shift(k).corr(other), abs=1e-12)
    assert st.peak_lag(st.cross_correlation(both, "x", "y")).collect()[0]["peak_lag"] == 3


def test_seasonal_profile_against_pandas(noisy):
    df, pdf = noisy
    filled = sp.interpolate_time(sp.fill_gaps(df), ["revenue"])
    pdf = pdf.interpolate(method="time")
    norm = pdf / pdf.groupby(pdf.index.year).transform("mean")
    want = norm.groupby([norm.index.month, norm.index.day]).mean()
    for r in bl.seasonal_profile(filled, ["revenue"]).collect():
        assert r["revenue_profile"] == pytest.approx(want[(r["month"], r["day"])], rel=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(-50, 50), min_size=1, max_size=60), hs.sampled_from([1, 3, 16]))
def test_rank_properties(spark, values, ranges):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g STRING, value DOUBLE")
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    got = histogram_ranks(counts, ["g"], ranges=ranges).collect()
    want = pd.Series(values, dtype=float).rank()
    lookup = dict(zip(map(float, values), want))
    assert {r["value"]: r["avg_rank"] for r in got} == lookup
    assert sum(r["n"] * r["avg_rank"] for r in got) == len(values) * (len(values) + 1) / 2


def test_hot_value_and_outlier_in_rank_histogram(spark):
    """A third of all rows on one value, and one value far away, still give exact ranks."""
    df = spark.range(9000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") == 1, 1e12)
                                  .otherwise((F.col("id") % 997).cast("double")).alias("value"))
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    got = {r["value"]: r["avg_rank"] for r in histogram_ranks(counts, ["g"], ranges=16).collect()}
    values = df.toPandas()["value"]
    want = dict(zip(values, values.rank()))
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(-30, 30), min_size=1, max_size=50), hs.sampled_from([1, 4, 20]))
def test_exact_quantiles(spark, values, ranges):
    counts = spark.createDataFrame([("g", float(v)) for v in values], "g STRING, value DOUBLE").groupBy("g", "value").agg(F.count("*").alias("n"))
    got = histogram_quantiles(counts, ["g"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}, ranges=ranges).collect()[0]
    assert [got[k] for k in "abcde"] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])))


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_share_over_many_labels(spark, keys):
    """Thousands of labels, most of one key: no range holds a whole group."""
    df = spark.range(4000).select(F.when(F.col("id") % 5 == 0, "small").otherwise("large").alias("k"), F.format_string("l%05d", "id").alias("label"),
                                  (F.col("id") * 37 % 101 + 1).cast("double").alias("v"))
    got = {r["label"]: (r["share_pct"], r["cum_pct"]) for r in ag.share_cumulative(df, "label", "v", keys).collect()}
    pdf = df.toPandas().sort_values(["v", "label"], ascending=[False, True])
    by = pdf["k"] if keys else pd.Series("all", pdf.index)
    total = pdf["v"].groupby(by).transform("sum")
    want = zip(pdf["label"], 100 * pdf["v"] / total, 100 * pdf["v"].groupby(by).cumsum() / total)
    assert got == {label: (pytest.approx(a), pytest.approx(b)) for label, a, b in want}
    layout = ranged(df, list(keys), [F.col("v").desc(), F.col("label")], 8).groupBy("_range").count().collect()
    assert len(layout) == 8 and max(r["count"] for r in layout) < 4000 / 8 * 2


def test_capped_never_above_raw_and_spine_contiguous(noisy):
    df, _ = noisy
    out = dn.cap_outliers(sp.interpolate_time(sp.fill_gaps(df), ["revenue"]), "revenue")
    assert out.where(F.col("clean_revenue") > F.col("revenue") + 1e-9).count() == 0
    days = [r["ds"] for r in out.orderBy("ds").select("ds").collect()]
    assert all(b - a == timedelta(days=1) for a, b in zip(days, days[1:]))


def test_result_does_not_depend_on_partitions(noisy):
    df, _ = noisy
    two = df.unionByName(df.withColumn("series_id", F.lit("b")).withColumn("revenue", F.col("revenue") * 2))
    run = lambda d: sorted(map(tuple, dn.denoise_target(sp.load_panel(d, ["revenue"]), ["revenue"]).collect()))
    assert run(two.repartition(1)) == run(two.repartition(8, "ds"))


def test_no_leakage_from_the_future(spark):
    """Values after the training end change neither coefficients nor earlier features."""
    base = [100 + 10 * np.sin(i / 58) + (i % 7) for i in range(1100)]
    later = [v if i < 1000 else v * 5 for i, v in enumerate(base)]
    cut = str(day("2018-01-01", 999))
    fits = []
    for values in (base, later):
        df = series(spark, "2018-01-01", values)
        coef = structural_fit(df, "revenue", StructuralParams(), cut).collect()[0]
        feats = df.select("ds", wn.lag_days(F.col("revenue"), 365).alias("l"), wn.lagged_mean(F.col("revenue"), 365, 28).alias("m"))
        fits.append((coef["trend_coef"], coef["season_coef"], [tuple(r) for r in feats.where(F.col("ds") <= cut).orderBy("ds").collect()]))
    assert fits[0] == fits[1]


def test_structural_model_recovers_a_known_signal(spark):
    i = np.arange(4 * 365)
    dates = pd.date_range("2015-01-01", periods=len(i))
    season = 0.3 * np.sin(2 * np.pi * (dates.dayofyear / 365.25)) + 0.1 * (dates.dayofweek == 5)
    level = 1000 + 0.4 * i
    for mode, y in (("multiplicative", level * (1 + season)), ("additive", level + 1000 * season)):
        df = series(spark, "2015-01-01", y)
        days = sp.date_spine(df, end="2019-06-30")
        params = StructuralParams(mode=mode)
        out = structural_predict(structural_fit(df, "revenue", params, "2018-06-30"), days, params).toPandas()
        out["ds"] = pd.to_datetime(out["ds"])
        pred = out.set_index("ds")["structural_pred"].sort_index()
        held = slice("2018-07-01", "2018-12-30")
        truth = pd.Series(y, index=dates)
        assert (abs(pred[held] - truth[held]) / truth[held]).mean() < 0.05
