"""Symmetric boosted trees against plain Python: equal splits, exact Shapley values, folds and trials as keys, the search."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidecast.operators import boosting as bt, evaluation as evl

COLUMNS = ("f1", "f2", "f3")


def sample(n=90, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 9, n)]).astype(float)
    return x, 3 * (x[:, 0] > 2) - x[:, 1] * (x[:, 2] > 4) + rng.normal(0, 0.2, n)


def frame(spark, x, y, name="a"):
    rows = [(name, day("2020-01-01", i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "series_id STRING, ds DATE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, label DOUBLE")


def brute_trees(x, y, p):
    """(features, cuts) of every tree by trying every cut on every level, and the fitted values."""
    score = lambda g: max(abs(sum(g)) - p.l1, 0) ** 2 / (len(g) + p.l2) if len(g) else 0.0
    pred, out = [float(np.mean(y))] * len(y), []
    for _ in range(p.rounds):
        g = [a - b for a, b in zip(y, pred)]
        scale, nodes, asked = sum(v * v for v in g), [list(range(len(y)))], []
        for _ in range(p.depth):
            best = (0.0, None, None)
            for j in range(x.shape[1]):
                values = sorted(set(x[:, j]))
                for lo, hi in zip(values, values[1:]):
                    cut, gain = (lo + hi) / 2, 0.0
                    for rows in nodes:
                        low, high = [g[i] for i in rows if x[i, j] <= cut], [g[i] for i in rows if x[i, j] > cut]
                        if min(len(low), len(high)) >= p.min_leaf:
                            gain += score(low) + score(high) - score(low + high)
                    if round(gain / scale, bt.DIGITS) > best[0]:
                        best = (round(gain / scale, bt.DIGITS), j, cut)
            if best[1] is None:
                break
            _, j, cut = best
            asked.append((j, cut))
            nodes = [[i for i in rows if (x[i, j] > cut) == side] for rows in nodes for side in (False, True)]
        out.append(asked)
        for i in range(len(y)):
            for depth in range(len(asked), -1, -1):                       # the deepest node above the leaf that has enough rows
                rows = [k for k in range(len(y)) if all((x[k, j] > c) == (x[i, j] > c) for j, c in asked[:depth])]
                if len(rows) >= p.min_leaf or depth == 0:
                    total = sum(g[k] for k in rows)
                    pred[i] += p.step * np.sign(total) * max(abs(total) - p.l1, 0) / (len(rows) + p.l2)
                    break
    return out, pred


@pytest.mark.parametrize("params", [bt.TreeParams(rounds=6, depth=3, step=0.3), bt.TreeParams(rounds=5, depth=2, step=0.5, min_leaf=12, l1=0.5, l2=1.0)],
                         ids=["shallow", "limited"])
def test_equal_splits_and_values_to_brute_force(spark, params):
    x, y = sample()
    df = frame(spark, x, y)
    trees = bt.fit_trees(df, "label", COLUMNS, params)
    want, fitted = brute_trees(x, y, params)
    got = trees.orderBy("tree").collect()
    assert [[(COLUMNS.index(f), c) for f, c in zip(r.features, r.cuts)] for r in got] == want
    assert all(sum(r.covers) == r.train_rows == len(y) for r in got)
    pred = [r.residual_pred for r in bt.predict_trees(trees, df).orderBy("ds").collect()]
    assert pred == pytest.approx(fitted, abs=1e-9)


def test_order_of_rows_does_not_matter(spark):
    x, y = sample(200)
    df = frame(spark, x, y)
    p = bt.TreeParams(rounds=20, depth=3, row_share=0.7, column_share=0.7)
    one, two = (bt.fit_trees(d, "label", COLUMNS, p).orderBy("tree").collect() for d in (df, df.orderBy(F.rand(1)).repartition(5)))
    assert one == two


def test_missing_values_take_the_low_side_and_unknown_series_none(spark):
    x, y = sample()
    df = frame(spark, x, y).withColumn("note", F.lit("kept")).withColumn("k", F.lit(None).cast("int"))
    trees = bt.fit_trees(df, "label", COLUMNS, bt.TreeParams(rounds=10))
    low = df.withColumn("f1", F.lit(-1e9)).orderBy("ds")
    gone = df.withColumn("f1", F.lit(None).cast("double"))
    pred = lambda d: [r.residual_pred for r in bt.predict_trees(trees, d).orderBy("ds").collect()]
    assert pred(low) == pred(gone)
    other = bt.predict_trees(trees, df.withColumn("series_id", F.lit("b")))
    assert other.columns == [*df.columns, "residual_pred"]
    assert other.where("residual_pred is null and note = 'kept' and k is null").count() == len(y)


def test_rows_without_label_or_feature_do_not_train(spark):
    x, y = sample()
    df = frame(spark, x, y)
    holes = df.withColumn("f2", F.when(F.col("f1") < 5, F.col("f2"))).withColumn("label", F.when(F.col("f3") < 8, F.col("label")))
    trees = bt.fit_trees(holes, "label", COLUMNS, bt.TreeParams(rounds=3))
    assert trees.first().train_rows == int(((x[:, 0] < 5) & (x[:, 2] < 8)).sum())
    assert bt.fit_trees(df.withColumn("f1", F.lit(None).cast("double")), "label", COLUMNS).count() == 0
    flat = bt.fit_trees(df.withColumn("label", F.lit(2.5)), "label", COLUMNS)
    assert [(r.base, r.features) for r in flat.collect()] == [(2.5, [])]
    assert bt.predict_trees(flat, df).where("residual_pred <> 2.5").count() == 0


def test_early_stop_keeps_the_best_round(spark):
    x, y = sample(300)
    rng = np.random.default_rng(1)
    df = frame(spark, x, y + rng.normal(0, 2, len(y))).withColumn("held", F.dayofmonth("ds") % 3 == 0)
    p = bt.TreeParams(rounds=400, step=0.5, depth=3, patience=20)
    short, full = bt.fit_trees(df, "label", COLUMNS, p, held_out="held"), bt.fit_trees(df.where("not held"), "label", COLUMNS, bt.TreeParams(rounds=400, step=0.5))
    assert short.count() < 400 == full.count()
    assert [r.cuts for r in short.orderBy("tree").collect()] == [r.cuts for r in full.orderBy("tree").collect()][:short.count()]
    mae = bt.predict_trees(short, df.where("held")).agg(F.avg(F.abs(F.col("label") - F.col("residual_pred")))).first()[0]
    assert mae == pytest.approx(short.first().held_out_mae)


def test_settings_are_fitted_side_by_side(spark):
    x, y = sample()
    df = frame(spark, x, y).unionByName(frame(spark, x[::-1], y, "b"))
    settings = {"all": (COLUMNS, bt.TreeParams(rounds=4)), "one": (("f2",), bt.TreeParams(rounds=7, depth=1))}
    many = bt.fit_settings(df, "label", settings)
    assert {(r.setting, r.series_id): r.n for r in many.groupBy("setting", "series_id").agg(F.count("*").alias("n")).collect()} == {
        ("all", "a"): 4, ("all", "b"): 4, ("one", "a"): 7, ("one", "b"): 7}
    alone = bt.fit_trees(df, "label", *settings["one"])
    assert sorted(map(str, many.where("setting = 'one'").drop("setting").collect())) == sorted(map(str, alone.collect()))


def brute_shapley(tree, row, names):
    """Shapley values of one tree by all subsets, walking its questions."""
    def expected(known, level=0, prefix=0):
        if level == len(tree.features):
            return tree.leaves[prefix]
        ends = lambda p, lv: sum(c for k, c in enumerate(tree.covers) if k & ((1 << lv) - 1) == p)
        sides = [prefix, prefix | 1 << level]
        name = tree.features[level]
        if name in known:
            return expected(known, level + 1, sides[row[name] > tree.cuts[level]])
        n = [ends(s, level + 1) for s in sides]
        share = n[1] / sum(n) if sum(n) else 0.5
        return (1 - share) * expected(known, level + 1, sides[0]) + share * expected(known, level + 1, sides[1])
    out = {}
    for f in names:
        rest = [g for g in names if g != f]
        out[f] = sum(factorial(k) * factorial(len(rest) - k) / factorial(len(names)) * (expected({*s, f}) - expected(set(s)))
                     for k in range(len(rest) + 1) for s in combinations(rest, k))
    return out


def test_shapley_values_equal_enumeration_and_add_up(spark):
    x, y = sample()
    df = frame(spark, x, y)
    trees = bt.fit_trees(df, "label", COLUMNS, bt.TreeParams(rounds=5, depth=4, step=0.4, min_leaf=3))
    model = trees.orderBy("tree").collect()
    got = bt.shapley_values(trees, df, COLUMNS).orderBy("ds").collect()
    pred = [r.residual_pred for r in bt.predict_trees(trees, df).orderBy("ds").collect()]
    for r, p in zip(got, pred):
        assert r.base_value + sum(r.effects) == pytest.approx(r.prediction) == pytest.approx(p)
    for r in got[:12]:
        want = [brute_shapley(t, r, COLUMNS) for t in model]
        assert r.effects == pytest.approx([sum(w[c] for w in want) for c in COLUMNS])
    assert np.mean(pred) == pytest.approx(got[0].base_value)
    share = {r.feature: r.importance for r in bt.split_importance(trees).collect()}
    assert sum(share.values()) == pytest.approx(1) and max(share, key=share.get) == "f1"
    mean = {r.feature: r.mean_abs_effect for r in bt.shapley_importance(bt.shapley_values(trees, df, COLUMNS), COLUMNS).collect()}
    assert mean == pytest.approx({c: np.mean([abs(r.effects[k]) for r in got]) for k, c in enumerate(COLUMNS)})


def test_shuffling_a_feature_raises_the_error(spark):
    x, y = sample(300)
    df = frame(spark, x, y).withColumn("f4", F.lit(1.0))
    trees = bt.fit_trees(df, "label", (*COLUMNS, "f4"), bt.TreeParams(rounds=40))
    got = {r.feature: r.delta_mae for r in bt.shuffled_errors(trees, df, "label", (*COLUMNS, "f4")).collect()}
    assert got["f1"] > 0.3 and got["f4"] == 0


def test_fold_rows_train_on_lower_blocks_only(spark):
    df = frame(spark, *sample(22)).withColumnRenamed("label", "residual")
    rows = evl.fold_rows(df, columns=COLUMNS).orderBy("fold", "ds").collect()
    assert [(r.fold, sum(x.fold == r.fold and not x.held_out for x in rows), sum(x.fold == r.fold and x.held_out for x in rows)) for r in rows[::1]][0] == (1, 7, 5)
    for k, n in ((1, 7), (2, 12), (3, 17)):
        mine = [r for r in rows if r.fold == k]
        assert [r.held_out for r in mine] == [False] * n + [True] * 5


def test_search_halves_and_repeats(spark):
    df = frame(spark, *sample(240)).withColumnRenamed("label", "residual")
    rungs = ((6, 15), (3, 40), (2, 80))
    one, two = (evl.param_search(df, columns=COLUMNS, rungs=rungs).collect() for _ in range(2))
    assert one == two and sorted(r.trial for r in one) == list(range(11))
    assert [sum(r.rung == k for r in one) for k in (1, 2, 3)] == [4, 3, 4]    # 2 of 6 go on, then 2 of 5 → with 2 new ones, 4
    top = [r.cv_mae for r in one if r.rung == 3]
    assert top == sorted(top) and all(r.rounds == rungs[r.rung - 1][1] for r in one)
    for r in one:
        assert 0.01 <= r.step <= 0.1 and 3 <= r.depth <= 6 and 10 <= r.min_leaf <= 60 and 0.6 <= r.row_share <= 1 and 1e-3 <= r.l2 <= 10


def test_proposals_move_towards_good_trials():
    rng = np.random.default_rng(0)
    points = rng.random((40, 3))
    losses = np.abs(points - 0.8).sum(1)
    drawn = np.array([evl.propose(points, losses, rng) for _ in range(30)])
    assert np.abs(drawn - 0.8).mean() < 0.75 * np.abs(points - 0.8).mean() and (0 <= drawn).all() and (drawn <= 1).all()
