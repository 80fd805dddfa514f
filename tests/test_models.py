"""Boosted learner, recursion, folds and autoregression on small synthetic series."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day, series
from tidecast.operators import arma as am, boosted as bo, boosting as bt, evaluation as evl, recursive as rc
from tidecast.operators.spine import date_spine


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = [("a", day("2018-01-01", i), float(a), float(b), float(3 * (a > 0.5) - b)) for i, (a, b) in enumerate(rng.random((600, 2)))]
    return spark.createDataFrame(rows, "series_id STRING, ds DATE, f1 DOUBLE, f2 DOUBLE, label DOUBLE")


def test_boosting_learns_and_accepts_missing_features(labelled):
    model = bo.gbt_fit(labelled, "label", ("f1", "f2"), bo.BoostParams(max_iter=8, step_size=0.3))
    scored = bo.gbt_predict(model, labelled, ("f1", "f2"))
    mae = scored.agg(F.avg(F.abs(F.col("label") - F.col("residual_pred")))).collect()[0][0]
    assert mae < 0.25
    holes = labelled.withColumn("f1", F.when(F.col("ds") > "2019-01-01", F.col("f1")))
    out = bo.gbt_predict(model, holes, ("f1", "f2"))
    assert out.where(F.col("residual_pred").isNull()).count() == 0
    assert out.where(F.col("f1").isNull()).count() == holes.where(F.col("f1").isNull()).count()


def test_training_rows_need_every_feature(labelled):
    holes = labelled.withColumn("f2", F.when(F.col("f1") > 0.5, F.col("f2")))
    assert bo.training_rows(holes, "label", ("f1", "f2")).count() == labelled.where("f1 > 0.5").count()


def test_recursion_feeds_predictions_back(spark):
    """Second-year predictions read the first year's predicted residuals, and the block-end gap of the 364-day lag shows."""
    df = series(spark, "2019-01-01", [10.0] * 731, col="residual")
    days = date_spine(df, end="2022-06-30").join(df, ["series_id", "ds"], "left")
    state = days.withColumn("structural_pred", F.lit(100.0)).withColumn("structural_trend", F.lit(100.0))
    halve = lambda f: f.withColumn("residual_pred", F.col("resid_lag365") / 2)
    out = {r["ds"]: r for r in rc.recursive_forecast(state, halve, "2021-01-01", "2022-06-30").collect()}
    assert out[date(2021, 3, 1)]["forecast"] == 105.0
    assert out[date(2022, 3, 1)]["forecast"] == 102.5
    assert len(out) == 365 + 181
    from tidecast.operators.features import future_safe_features
    feats = future_safe_features(state).where(F.col("ds").between("2021-01-01", "2021-12-31"))
    gaps = rc.missing_cells(feats, ["resid_lag364"]).collect()[0]
    assert gaps["missing_cells"] == 1      # 31 December reads 1 January of the same year


def test_year_blocks():
    assert rc.year_blocks("2001-01-01", "2002-07-01") == [(date(2001, 1, 1), date(2001, 12, 31)), (date(2002, 1, 1), date(2002, 7, 1))]


def test_expanding_folds_match_the_usual_split(spark):
    df = series(spark, "2020-01-01", range(22))
    fold = [r["fold"] for r in evl.expanding_folds(df, 3).orderBy("ds").collect()]
    assert fold == [0] * 7 + [1] * 5 + [2] * 5 + [3] * 5     # 22 // 4 = 5 rows per test block


def test_autoregression_follows_a_known_recurrence(spark):
    d = [1.0, -0.5, 0.8, 0.3, -0.2]
    for _ in range(400):
        d.append(0.6 * d[-1] - 0.3 * d[-2])
    y = list(100 + np.cumsum(np.array(d)))
    df = series(spark, "2020-01-01", y[:40])
    out = am.arma_forecast(df, "revenue", "2020-02-09", "2020-02-14", am.ArmaOrder(5, 1, 0)).orderBy("ds").collect()
    assert [r["pred"] for r in out] == pytest.approx(y[40:45], abs=1e-3)


def test_hybrid_runs_end_to_end(spark):
    i = np.arange(3 * 365 + 366 + 365)
    y = 100 + 20 * np.sin(2 * np.pi * i / 365.25) + (i % 7)
    df = series(spark, "2015-01-01", y).withColumn("cogs", F.col("revenue") * 0.8)
    panel = df.withColumn("clean_revenue", F.col("revenue")).withColumn("clean_cogs", F.col("cogs"))
    split = dict(train_end="2018-12-31", val_start="2019-01-01", val_end="2019-12-31", test_start="2020-01-01", test_end="2021-02-28")
    out = evl.hybrid_validation(panel, None, split, columns=evl.BASE_FEATURES, boost=bt.TreeParams(rounds=2))
    assert out.count() == 365
    err = out.agg(F.avg(F.abs(F.col("actual") - F.col("pred")))).collect()[0][0]
    assert err < 5
