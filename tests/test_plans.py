"""Physical plans: pushed filters, pruned columns, one layout per panel, no nested loops over raw rows."""

import re

import pytest

from tests.conftest import SMALL
from tidecast.operators import denoise as dn, recursive as rc, stats as st
from tidecast.operators.features import future_safe_features
from tidecast.plans import catalog, inputs as src

ROW_LEVEL = ("agg_basic", "average_rank", "kruskal_wallis_orders", "cap_outliers", "spread_anomaly", "future_safe_features",
             "join_items_orders", "category_mix", "early_warning_points", "event_window_join", "interval_join_promo", "ccf")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_panel_chain_has_one_exchange_after_the_daily_totals(spark):
    text = plan(dn.denoise_target(src.panel(spark, SMALL)))
    assert len(re.findall(r"Exchange hashpartitioning\(series_id", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2      # daily totals, then the panel layout
    assert "SinglePartition" not in text


def test_feature_matrix_adds_no_exchange(spark):
    p = src.naive_panel(spark, SMALL)
    count = lambda df: len(re.findall(r"Exchange hashpartitioning", plan(df)))
    assert count(future_safe_features(p)) == count(p)


def test_spread_and_decomposition_need_no_join(spark):
    p = src.panel(spark, SMALL)
    for df in (st.spread_anomaly(p), st.seasonal_decompose(p, "revenue"), st.cointegration(p)):
        assert len(re.findall(r"Exchange hashpartitioning\(series_id", plan(df))) == 1


def test_scan_is_pruned_and_filtered(spark):
    text = plan(catalog.QUERIES["date_slice"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    text = plan(catalog.QUERIES["scan_dates"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)
    text = plan(catalog.QUERIES["join_items_orders"](spark, SMALL))
    assert "l_extendedprice" not in text.split("ReadSchema")[1]


def test_day_lag_needs_no_self_join(spark):
    assert "Join" not in plan(catalog.QUERIES["lag_calendar"](spark, SMALL)).split("HashAggregate")[0]


def test_a_year_of_the_recursion_scans_three_years(spark, tmp_path):
    """History of seven years on disk; the second forecast year lists the files of its own year and the two before it."""
    days = spark.sql("SELECT 'a' AS series_id, explode(sequence(DATE '1996-01-01', DATE '2004-06-30')) AS ds")
    state = days.selectExpr("*", "IF(ds < DATE '2003-01-01', sin(dayofyear(ds)), NULL) AS residual", "1.0D AS structural_pred", "1.0D AS structural_trend")
    whole = rc.recursive_forecast(state, rc.naive_residual, "2003-01-01", "2004-06-30", folder=str(tmp_path / "run"))
    assert whole.count() == 365 + 182
    part = rc.read_years(spark, str(tmp_path / "run/state"), state.schema, 2002, 2004)
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*2002", plan(part))
    recent = rc.recursive_forecast(state.where("ds >= '2001-01-01'"), rc.naive_residual, "2003-01-01", "2004-06-30")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, recent.collect()))
