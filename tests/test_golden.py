"""Hand-computed results on tiny tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import column, day, series
from tidecast.fixed_values import ALL_FEATURES
from tidecast.operators import aggregates as ag, decisions as de, denoise as dn, events as ev, forecasting as fc, spine as sp, stats as st, windows as wn
from tidecast.operators.features import future_safe_features
from tidecast.operators.ranks import average_rank, histogram_ranks


def test_gaps_and_interpolation_edges(spark):
    # leading NULL stays, gaps of one and three are linear, trailing NULL repeats
    df = series(spark, "2020-01-01", [None, 10, ..., 30, ..., ..., ..., 50, 60, None])
    dense = sp.fill_gaps(df)
    assert column(dense, "ds") == [day("2020-01-01", i) for i in range(10)]
    assert column(dense, "revenue") == [None, 10, None, 30, None, None, None, 50, 60, None]
    filled = sp.interpolate_time(dense, ["revenue"])
    assert column(filled, "revenue") == [None, 10, 20, 30, 35, 40, 45, 50, 60, 60]


def test_fill_gaps_equals_densify_on_own_spine(spark):
    df = series(spark, "2020-02-27", [1, ..., ..., 4, 5, ..., 7])
    a = sp.fill_gaps(df)
    b = sp.densify(df, sp.date_spine(df))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_year_filter_bounds(spark):
    rows = [("a", day("2017-01-01", i), 1.0) for i in range(359)]
    rows += [("a", day("2018-01-01", i), 1.0) for i in range(360)]
    rows += [("a", day("2020-01-01", i), 1.0) for i in range(366)]
    df = spark.createDataFrame(rows, "series_id STRING, ds DATE, revenue DOUBLE")
    kept = sp.complete_years(df).groupBy(F.year("ds").alias("y")).count().collect()
    assert {r["y"]: r["count"] for r in kept} == {2018: 360, 2020: 366}


def test_year_filter_counts_days_after_filling(spark):
    df = series(spark, "2019-01-01", [1.0] + [...] * 363 + [2.0])
    assert sp.load_panel(df, ["revenue"]).count() == 365


def test_monthly_fill_stops_on_last_snapshot(spark):
    monthly = spark.createDataFrame([(date(2020, 1, 1), 1.0), (date(2020, 3, 1), 3.0)], "snap DATE, x DOUBLE")
    spine = spark.createDataFrame([(day("2019-12-31", i),) for i in range(0, 100)], "ds DATE")
    got = {r["ds"]: r["x"] for r in sp.monthly_to_daily(monthly, spine, ["x"]).collect()}
    assert got[date(2019, 12, 31)] is None
    assert got[date(2020, 1, 1)] == got[date(2020, 1, 31)] == 1.0
    assert got[date(2020, 2, 15)] == 1.0          # missing month repeats the one before
    assert got[date(2020, 3, 1)] == 3.0
    assert got[date(2020, 3, 2)] is None          # after the last snapshot day
    filled = {r["ds"]: r["x"] for r in sp.monthly_to_daily(monthly, spine, ["x"], fill_last_month=True).collect()}
    assert filled[date(2020, 3, 31)] == 3.0 and filled[date(2020, 4, 1)] is None


def test_recurring_spike_is_kept_and_single_spike_capped(spark):
    rows = []
    for y in (2016, 2017, 2018, 2019):
        for i in range(40):
            d = day(f"{y}-03-01", i)
            v = 100.0 + (i % 5)
            if (d.month, d.day) == (3, 20) and y != 2019:
                v = 200.0     # 3 of 4 years: 0.75 >= 0.7
            if (d.month, d.day) == (4, 5) and y in (2016, 2018):
                v = 200.0     # 2 of 4 years
            rows.append(("a", d, v))
    df = spark.createDataFrame(rows, "series_id STRING, ds DATE, revenue DOUBLE")
    marked = {r["ds"]: r["is_recurring"] for r in dn.detect_recurring(df, "revenue").collect()}
    assert marked[date(2016, 3, 20)] and marked[date(2019, 3, 20)]
    assert not marked[date(2016, 4, 5)]
    clean = {r["ds"]: r for r in dn.cap_outliers(df, "revenue", n_sigma=2.0).collect()}
    assert clean[date(2017, 3, 20)]["clean_revenue"] == 200.0
    assert 104.0 < clean[date(2018, 4, 5)]["clean_revenue"] < 200.0
    assert clean[date(2018, 4, 6)]["clean_revenue"] == clean[date(2018, 4, 6)]["revenue"]


def test_centred_window_bounds(spark):
    df = series(spark, "2020-01-01", range(40))
    before, after = wn.centred(30)
    assert (before, after) == (15, 14)
    got = column(wn.rolling(df, "revenue", before, after, "mean", 7, "m"), "m")
    assert got[0] == sum(range(0, 15)) / 15       # rows 0..14
    assert got[20] == sum(range(5, 35)) / 30      # rows 5..34
    assert got[39] == sum(range(24, 40)) / 16
    short = column(wn.rolling(series(spark, "2020-01-01", range(6)), "revenue", 15, 14, "mean", 7, "m"), "m")
    assert short == [None] * 6


def test_trailing_window_is_null_until_full(spark):
    out = column(wn.rolling(series(spark, "2020-01-01", [1, 2, 3, 4]), "revenue", 2, 0, "mean", 3, "m"), "m")
    assert out == [None, None, 2.0, 3.0]


def test_calendar_lag_counts_days_not_rows(spark):
    df = series(spark, "2019-12-25", range(440))
    out = {r["ds"]: r for r in wn.lag_calendar(df, ["revenue"], 365).collect()}
    assert out[date(2020, 12, 23)]["revenue_lag365"] is None
    assert out[date(2020, 12, 24)]["revenue_lag365"] == 0.0   # 2020 is a leap year
    gappy = df.where(F.col("ds") != F.to_date(F.lit("2020-01-10")))
    out = {r["ds"]: r for r in wn.lag_calendar(gappy, ["revenue"], 365).collect()}
    assert out[date(2021, 1, 9)]["revenue_lag365"] is None
    assert out[date(2021, 1, 10)]["revenue_lag365"] == 17.0


def test_event_window_needs_both_ends(spark):
    df = series(spark, "2020-01-01", range(40))
    events = spark.createDataFrame([("in", date(2020, 1, 10)), ("early", date(2020, 1, 5)), ("late", date(2020, 2, 1))],
                                   "promo_name STRING, start_date DATE")
    lift = ev.event_lift(df, events)
    assert {r["promo_name"] for r in lift.select("promo_name").distinct().collect()} == {"in"}
    by_offset = {r["offset"]: r["lift_pct"] for r in lift.collect()}
    assert sorted(by_offset) == list(range(-7, 15))
    base = sum(range(2, 10)) / 8                   # days -7..0 are values 2..9
    assert by_offset[0] == pytest.approx((9 / base - 1) * 100)
    assert by_offset[14] == pytest.approx((23 / base - 1) * 100)


def test_ratio_table_and_default(spark):
    rows = [("a", date(2019, 1, d), 100.0, c) for d, c in ((1, 70.0), (2, 80.0), (3, 90.0))]
    rows += [("a", date(2020, 1, 1), 100.0, 10.0), ("a", date(2020, 2, 1), 100.0, 500.0)]   # clipped to 0.5 and 1.6
    hist = spark.createDataFrame(rows, "series_id STRING, ds DATE, revenue DOUBLE, cogs DOUBLE")
    want = spark.createDataFrame([("a", date(y, m, 15), 1000.0) for y, m in ((2021, 1), (2022, 1), (2022, 2), (2021, 7))],
                                 "series_id STRING, ds DATE, revenue_pred DOUBLE")
    got = {r["ds"]: r["ratio_pred"] for r in fc.cogs_from_ratio(want, hist, "2020-12-31").collect()}
    assert got[date(2021, 1, 15)] == 0.8           # odd January
    assert got[date(2022, 1, 15)] == 0.5           # even January, clipped
    assert got[date(2022, 2, 15)] == 1.6
    assert got[date(2021, 7, 15)] == 0.8           # no cell: overall median of 0.5 0.7 0.8 0.9 1.6


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 3, 3, 3)] + [("k", 7.0)] * 3, "g STRING, value DOUBLE")
    by_window = sorted((r["g"], r["value"], r["r"]) for r in df.withColumn("r", average_rank(F.col("value"), ["g"])).collect())
    assert by_window == [("g", 1.0, 1.0), ("g", 2.0, 2.5), ("g", 2.0, 2.5), ("g", 3.0, 5.0), ("g", 3.0, 5.0), ("g", 3.0, 5.0),
                         ("k", 7.0, 2.0), ("k", 7.0, 2.0), ("k", 7.0, 2.0)]
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    for ranges in (1, 2, 40):
        got = sorted((r["g"], r["value"], r["avg_rank"]) for r in histogram_ranks(counts, ["g"], ranges=ranges).collect())
        assert got == sorted(set(by_window))


def test_mann_whitney_and_kruskal_known_values(spark):
    # x = 1 3 5 (flag) against 2 4: ranks 1 3 5 -> U = 9 - 6 = 3
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("a", 5.0, 1), ("a", 2.0, 0), ("a", 4.0, 0)], "g STRING, y DOUBLE, f INT")
    r = st.mann_whitney(df, "y", "f", ["g"]).collect()[0]
    assert (r["u"], r["n_flagged"], r["n_other"], r["effect_pct"]) == (3.0, 3, 2, 0.0)
    # groups 1 2 3 | 4 5 6 | 7 8 9: H = 7.2
    long = spark.createDataFrame([("a", float(i), (i - 1) // 3) for i in range(1, 10)], "g STRING, y DOUBLE, level INT")
    assert st.kruskal(long, "y", "level", ["g"]).collect()[0]["h"] == pytest.approx(7.2)
    assert st.kruskal_rows(long, "y", "level", ["g"]).collect()[0]["h"] == pytest.approx(7.2)
    row = st.with_group_verdict(st.kruskal(long, "y", "level", ["g"])).collect()[0]
    assert row["p_value"] == pytest.approx(0.02732372, abs=1e-7) and row["keep"]


def test_constant_input_has_no_statistic(spark):
    long = spark.createDataFrame([("a", 5.0, float(i), i % 2) for i in range(6)], "g STRING, x DOUBLE, y DOUBLE, level INT")
    assert st.spearman(long, "x", "y", ["g"]).collect()[0]["r"] is None
    assert st.kruskal(long.withColumn("y", F.lit(5.0)), "y", "level", ["g"]).collect()[0]["h"] is None


def test_metrics_skip_zero_and_flat_targets(spark):
    df = spark.createDataFrame([("m", "t", 0.0, 1.0), ("m", "t", 10.0, 8.0), ("m", "t", 20.0, 25.0), ("m", "t", None, 3.0),
                                ("m", "flat", 4.0, 5.0), ("m", "flat", 4.0, 4.0)], "model STRING, target STRING, y DOUBLE, pred DOUBLE")
    got = {r["target"]: r for r in fc.forecast_metrics(df).collect()}
    t = got["t"]
    assert t["n"] == 3 and t["mae"] == pytest.approx(8 / 3) and t["rmse"] == pytest.approx((30 / 3) ** 0.5)
    assert t["r2"] == pytest.approx(1 - 30 / 200) and t["mape"] == pytest.approx((0.2 + 0.25) / 2 * 100)
    assert got["flat"]["r2"] is None


def test_postprocess_and_contract(spark):
    f = spark.createDataFrame([("a", date(2023, 1, 1), -5.0, 0.125), ("a", date(2023, 1, 2), 0.375, 2.0), ("a", date(2023, 1, 4), 10.0, 4.0)],
                              "series_id STRING, ds DATE, revenue DOUBLE, cogs DOUBLE")
    out = fc.postprocess(f)
    assert column(out, "revenue") == [0.0, 0.38, 10.0] and column(out, "cogs") == [0.12, 2.0, 4.0]
    assert column(fc.postprocess(f, cap_cogs=True), "cogs") == [0.0, 0.38, 4.0]
    audit = fc.loss_audit(out).collect()[0]
    assert audit["loss_days"] == 2 and audit["suspicious"]
    template = spark.createDataFrame([("a", date(2023, 1, d)) for d in (1, 2, 3)], "series_id STRING, ds DATE")
    c = fc.submission_contract(template, f).collect()[0]
    assert (c["expected"], c["produced"], c["missing"], c["extra"], c["matches"]) == (3, 3, 1, 1, True)
    assert column(fc.follow_template(template, out), "revenue") == [0.0, 0.38, None]


def test_interval_clips_at_zero(spark):
    f = spark.createDataFrame([("a", date(2023, 1, 1), 1.0), ("a", date(2023, 1, 2), 100.0)], "series_id STRING, ds DATE, forecast DOUBLE")
    e = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", 3.0)], "series_id STRING, error DOUBLE")
    out = fc.prediction_interval(f, e)
    assert column(out, "lower_95") == [0.0, pytest.approx(100 - 1.96 * 2)]
    assert column(out, "upper_95")[0] == pytest.approx(1 + 1.96 * 2)


def test_feature_matrix_has_all_columns_and_known_gaps(spark):
    n = 366 + 365 + 365
    df = series(spark, "2020-01-01", range(n), col="residual").withColumn("structural_trend", F.lit(1.0))
    for c in ("fill_rate_lag365", "days_of_supply_lag365", "overstock_pct_lag365", "sessions_lag365", "fill_rate_lag730", "sessions_lag730"):
        df = df.withColumn(c, F.lit(0.0))
    out = future_safe_features(df)
    assert set(out.columns) == {"series_id", "ds", *ALL_FEATURES} and len(ALL_FEATURES) == 23
    r = {x["ds"]: x for x in out.collect()}
    d = r[date(2022, 1, 15)]
    i = (date(2022, 1, 15) - date(2020, 1, 1)).days
    assert (d["resid_lag364"], d["resid_lag365"], d["resid_lag366"], d["resid_lag730"]) == (i - 364, i - 365, i - 366, i - 730)
    assert d["resid_roll28_lag365"] == sum(range(i - 392, i - 364)) / 28
    assert r[date(2020, 12, 31)]["resid_roll28_lag365"] == 0.0   # one value is enough
    assert r[date(2021, 8, 31)]["urban_expected"] == 1 and r[date(2022, 8, 1)]["urban_expected"] == 0
    assert r[date(2021, 3, 18)]["days_to_promo"] == 0 and r[date(2021, 12, 31)]["days_to_promo"] == 43
    assert r[date(2021, 1, 4)]["dayofweek"] == 0 and r[date(2021, 1, 4)]["weekofyear"] == 1
    assert r[date(2021, 2, 28)]["is_month_end"] == 1 and r[date(2021, 1, 29)]["week_of_month"] == 5


def test_event_calendar_edges(spark):
    days = spark.createDataFrame([(day("2012-12-25", i),) for i in range(60)], "ds DATE")
    m = {r["ds"]: r for r in ev.event_matrix(days).collect()}
    assert m[date(2012, 12, 28)]["end_of_month"] == 1 and m[date(2012, 12, 27)]["end_of_month"] == 0
    assert m[date(2013, 1, 3)]["start_of_month"] == 1 and m[date(2013, 1, 4)]["start_of_month"] == 0
    assert m[date(2013, 2, 8)]["tet"] == 1 and m[date(2013, 2, 17)]["tet"] == 1 and m[date(2013, 2, 18)]["tet"] == 0
    # day 322 of 2012 is 17 November; 45 days run to 31 December, 46th would be 1 January
    assert m[date(2012, 12, 31)]["promo_yearend"] == 1 and m[date(2013, 1, 1)]["promo_yearend"] == 0
    late = spark.createDataFrame([(date(2014, 1, 1),), (date(2014, 1, 2),)], "ds DATE")
    m = {r["ds"]: r for r in ev.event_matrix(late).collect()}
    assert m[date(2014, 1, 1)]["promo_yearend"] == 1 and m[date(2014, 1, 2)]["promo_yearend"] == 0   # 2013 wraps one day
    assert {r["promo_yearend"] for r in ev.event_matrix(late, first_year=2014).collect()} == {0}
    assert m[date(2014, 1, 1)]["promo_rural"] == 0
    dec = spark.createDataFrame([(date(2024, 12, 31),)], "ds DATE")
    assert ev.event_matrix(dec, last_year=2024).collect()[0]["end_of_month"] == 0


def test_decision_rules(spark):
    z = spark.createDataFrame([(-9.0,), (-10.0,), (-15.0,), (-20.0,), (-20.5,), (None,)], "traffic_yoy DOUBLE")
    assert [r["zone"] for r in de.warning_zone(z).collect()] == ["green", "green", "yellow", "yellow", "red", None]
    e = spark.createDataFrame([("a", date(2020, 1, 5), 0.10), ("a", date(2020, 1, 28), 0.30), ("a", date(2020, 1, 29), -0.2), ("a", date(2020, 1, 6), None)],
                              "series_id STRING, ds DATE, error DOUBLE")
    t = {r["buffer_pct"]: r for r in de.buffer_tradeoff(e).collect()}
    assert t[0]["stockout_pct"] == pytest.approx(200 / 3) and t[30]["stockout_pct"] == 0.0
    assert t[10]["excess_pct"] == pytest.approx((0 + 0 + 0.3) / 3 * 100)
    r = de.month_end_risk(e).collect()[0]
    assert (r["mid_risk_15"], r["end_risk_15"], r["end_risk_20"]) == (0.0, 50.0, 50.0)


def test_categories_of_the_pivot_come_from_the_data(spark):
    rows = [("2020-01-01", c, 1.0 + k) for k, c in enumerate("ABCDEFG")] + [("2021-01-01", "A", 9.0), ("2021-05-01", "A", 1.0)]
    df = spark.createDataFrame(rows, "ds STRING, category STRING, revenue DOUBLE").withColumn("ds", F.to_date("ds"))
    got = {r["year"]: r.asDict() for r in ag.pivot_categories(df, "category", "revenue").collect()}
    assert got[2020]["g"] == 7.0 and got[2021]["g"] == 0.0 and got[2021]["a"] == 10.0 and len(got[2020]) == 8
    long = {(r["year"], r["category"]): r["revenue"] for r in ag.category_years(df, "category", "revenue").collect()}
    assert len(long) == 14 and long[2021, "B"] == 0.0 and long[2020, "B"] == 2.0
    with pytest.raises(ValueError, match="more than 3"):
        ag.pivot_categories(df, "category", "revenue", most=3)
