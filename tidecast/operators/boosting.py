"""Boosted symmetric trees, one model per key.

A key is a series, and where several models are wanted also a fold, target, trial or feature set: all of them are fitted in one job, each on its own at most one row per
calendar day. Spark selects and lays out the rows, and everything after the fit is a table: one row per tree, which prediction, importances and Shapley values read.

A tree asks one question per level (symmetric tree), chosen by the gain summed over its nodes from histograms of gradient and count per node, feature and bin; with squared error the
curvature is the count. A side of fewer than ``min_leaf`` rows counts for no gain, and a leaf of fewer rows takes the value of the nearest node above that
has enough. Gains are compared to nine digits of the total variation, ties go to the first feature and lowest cut, so the order of additions never decides.
Missing values take the low side. For one model over rows of any number of series see ``boosted``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidecast.fixed_values import ALL_FEATURES
from tidecast.operators.spine import KEYS

DIGITS = 9
TREE_FIELDS = "tree int, base double, features array<string>, cuts array<double>, leaves array<double>, covers array<bigint>, gains array<double>, train_rows bigint, held_out_mae double"


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 300
    step: float = 0.099
    depth: int = 3
    l2: float = 3.0
    l1: float = 0.0
    min_leaf: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 128
    patience: int | None = None           # rounds without a better held-out mean absolute error before the fit stops
    seed: int = 42


# the two settings in use: shallow trees on everything, and the sampled, deeper variant
SHALLOW_TREES = TreeParams()
SAMPLED_TREES = TreeParams(step=0.05, depth=5, l2=1.0, l1=0.1, min_leaf=30, row_share=0.8, column_share=0.8)


# --- one model, in a task ------------------------------------------------------------------------

def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring distinct values, or between ``bins`` evenly spaced ranks where there are more."""
    v = np.unique(x)
    if len(v) > bins:
        v = np.unique(np.quantile(x, (np.arange(bins) + 0.5) / bins, method="lower"))
    return (v[1:] + v[:-1]) / 2


def _score(g: np.ndarray, n: np.ndarray, p: TreeParams) -> np.ndarray:
    return np.maximum(np.abs(g) - p.l1, 0.0) ** 2 / np.maximum(n + p.l2, 1e-12)


def best_split(cells: np.ndarray, g: np.ndarray, nodes: int, usable: np.ndarray, scale: float, p: TreeParams):
    """(feature, bin, gain) of the level; ``cells`` number the (node, feature, bin) of every row and feature."""
    shape = (nodes, *usable.shape)
    size = nodes * usable.size
    low_g = np.bincount(cells.ravel(), np.repeat(g, cells.shape[1]), size).reshape(shape).cumsum(2)
    low_n = np.bincount(cells.ravel(), minlength=size).reshape(shape).cumsum(2)
    all_g, all_n = low_g[:, :, -1:], low_n[:, :, -1:]
    gain = _score(low_g, low_n, p) + _score(all_g - low_g, all_n - low_n, p) - _score(all_g, all_n, p)
    both = (low_n >= p.min_leaf) & (all_n - low_n >= p.min_leaf)
    total = np.where(usable, np.round(np.where(both, gain, 0.0).sum(0) / scale, DIGITS), 0.0)
    at = int(total.argmax())
    return *divmod(at, usable.shape[1]), float(total.flat[at]) * scale


def leaf_values(node: np.ndarray, g: np.ndarray, depth: int, p: TreeParams) -> np.ndarray:
    """Step-scaled value of every leaf; a leaf of too few rows takes that of the node above it."""
    n, s = np.bincount(node, minlength=1 << depth), np.bincount(node, g, 1 << depth)
    out, open_ = np.zeros(1 << depth), np.ones(1 << depth, bool)
    prefix = np.arange(1 << depth)
    for level in range(depth, -1, -1):
        part = prefix & ((1 << level) - 1)
        count, total = np.bincount(part, n)[part], np.bincount(part, s)[part]
        use = open_ & ((count >= p.min_leaf) | (level == 0))
        shrunk = np.sign(total) * np.maximum(np.abs(total) - p.l1, 0.0) / np.maximum(count + p.l2, 1e-12)
        out[use], open_[use] = p.step * shrunk[use], False
    return out


def grow(x: np.ndarray, y: np.ndarray, p: TreeParams, held=None) -> tuple[list[tuple], float, float | None]:
    """Trees as (features, cuts, leaves, covers, gains), the base value, and the held-out error at the last tree kept."""
    n, m = x.shape
    cuts = [cut_points(x[:, j], p.bins) for j in range(m)]
    width = max(len(c) for c in cuts) + 1
    codes = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
    cells = codes + np.arange(m) * width
    real = np.arange(width)[None, :] < np.array([[len(c)] for c in cuts])
    base = float(y.mean())
    pred, trees, errors = np.full(n, base), [], []
    if held is not None:
        hx, hy = held
        held_codes = np.column_stack([np.searchsorted(c, hx[:, j]) for j, c in enumerate(cuts)])
        held_pred = np.full(len(hy), base)
    for t in range(p.rounds):
        rng = np.random.default_rng([p.seed, t])
        rows = rng.random(n) < p.row_share if p.row_share < 1 else np.ones(n, bool)
        usable = real
        if p.column_share < 1:
            usable = real.copy()
            usable[rng.permutation(m)[max(1, round(m * p.column_share)):]] = False
        g = y - pred
        scale = float((g[rows] ** 2).sum())
        if not scale:
            break
        node, splits = np.zeros(n, np.int64), []
        for level in range(p.depth):
            j, b, gain = best_split(node[rows, None] * (m * width) + cells[rows], g[rows], 1 << level, usable, scale, p)
            if gain <= 0:
                break
            node += (codes[:, j] > b).astype(np.int64) << level
            splits.append((j, b, gain))
        if not splits:
            if p.row_share < 1 or p.column_share < 1:
                continue
            break
        leaves = leaf_values(node[rows], g[rows], len(splits), p)
        pred += leaves[node]
        trees.append(([j for j, _, _ in splits], [float(cuts[j][b]) for j, b, _ in splits], leaves,
                      np.bincount(node, minlength=len(leaves)), [gain for _, _, gain in splits]))
        if held is not None:
            held_pred += leaves[sum((held_codes[:, j] > b).astype(np.int64) << k for k, (j, b, _) in enumerate(splits))]
            errors.append(float(np.abs(hy - held_pred).mean()) if len(hy) else 0.0)
            if p.patience is not None and len(errors) - 1 - int(np.argmin(errors)) >= p.patience:
                break
    if errors and p.patience is not None:
        trees = trees[:int(np.argmin(errors)) + 1]
    error = errors[len(trees) - 1] if errors else None if held is None else float(np.abs(held[1] - base).mean())
    return trees, base, error


def leaf_of(columns: dict[str, np.ndarray], features, cuts, n: int) -> np.ndarray:
    """Leaf of every row; comparing a missing value gives the low side."""
    node = np.zeros(n, np.int64)
    for level, (name, cut) in enumerate(zip(features, cuts)):
        node += (columns[name] > cut).astype(np.int64) << level
    return node


def leaf_effects(features, leaves, covers) -> tuple[list[str], np.ndarray]:
    """Shapley value of each feature of a tree for every leaf a row can fall in: the expected value given the known features, where
    unknown questions are answered in proportion to the training rows on each side of the node."""
    depth, names = len(features), list(dict.fromkeys(features))
    at = np.arange(1 << depth)

    def expected(known: frozenset) -> np.ndarray:
        v, c = np.broadcast_to(np.asarray(leaves, float), (1 << depth, 1 << depth)), np.asarray(covers, float)
        for level in range(depth - 1, -1, -1):
            half = 1 << level
            n = c[:half] + c[half:]
            high = np.where(n > 0, c[half:] / np.maximum(n, 1), 0.5)
            if features[level] in known:
                v = np.where((at >> level & 1)[:, None] == 1, v[:, half:], v[:, :half])
            else:
                v = v[:, :half] * (1 - high) + v[:, half:] * high
            c = n
        return v[:, 0]

    worth = {frozenset(s): expected(frozenset(s)) for k in range(len(names) + 1) for s in combinations(names, k)}
    out = np.zeros((1 << depth, len(names)))
    for i, name in enumerate(names):
        for s, without in worth.items():
            if name not in s:
                weight = factorial(len(s)) * factorial(len(names) - len(s) - 1) / factorial(len(names))
                out[:, i] += weight * (worth[s | {name}] - without)
    return names, out


# --- tables ----------------------------------------------------------------------------------------

def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def _dealt(df: DataFrame, keys) -> DataFrame:
    """One group per key, on a fixed number of partitions: models are heavy whatever the size of their rows, so small partitions must not be merged."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def fit_settings(rows: DataFrame, label: str, settings: dict[str, tuple[tuple[str, ...], TreeParams]], keys=KEYS, held_out: str | None = None,
                 order: str = "ds") -> DataFrame:
    """Tree tables of every setting (feature set and parameters) and key: (setting, keys, tree, …).

    Trains on rows that have the label and all features of the setting. ``held_out`` names a boolean column of rows that are kept from training and judge it.
    A key without training rows has no model.
    """
    columns = list(dict.fromkeys(c for cols, _ in settings.values() for c in cols))
    kept = rows.where(F.col(label).isNotNull()).select(
        *keys, order, *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y"),
        (F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)).alias("_held"),
        F.explode(F.array(*map(F.lit, settings))).alias("setting"))
    group = ["setting", *keys]
    schema = T.StructType([T.StructField("setting", T.StringType()), *_key_fields(rows, keys), *T._parse_datatype_string(TREE_FIELDS).fields])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        cols, params = settings[key[0].as_py()]
        table = table.sort_by(order)
        x, y, held = np.column_stack([_numbers(table, c) for c in cols]), _numbers(table, "_y"), table.column("_held").to_numpy()
        whole = ~np.isnan(x).any(1)
        train, judge = whole & ~held, whole & held
        out = []
        if train.any():
            trees, base, error = grow(x[train], y[train], params, (x[judge], y[judge]) if judge.any() else None)
            for t, (features, cuts, leaves, covers, gains) in enumerate(trees or [([], [], np.zeros(1), np.array([train.sum()]), [])]):
                out.append((t, base, [cols[j] for j in features], cuts, leaves.tolist(), covers.tolist(), gains, int(train.sum()), error))
        names = schema.names[len(group):]
        arrow = {f.name: _arrow_type(f.dataType) for f in schema.fields}
        parts = [pa.array([key[k].as_py()] * len(out), arrow[g]) for k, g in enumerate(group)]
        parts += [pa.array([r[k] for r in out], arrow[f]) for k, f in enumerate(names)]
        return pa.Table.from_arrays(parts, schema.names)

    return _dealt(kept, group).groupBy(*group).applyInArrow(fit, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def fit_trees(rows: DataFrame, label: str, columns=ALL_FEATURES, params: TreeParams = SHALLOW_TREES, keys=KEYS, held_out: str | None = None) -> DataFrame:
    """Tree table of one setting: (keys, tree, base, features, cuts, leaves, covers, gains, train_rows, held_out_mae)."""
    return fit_settings(rows, label, {"": (tuple(columns), params)}, keys, held_out).drop("setting")


def _with_models(features: DataFrame, trees: DataFrame, keys, added: list[T.StructField], fill) -> DataFrame:
    """Each key's rows with the columns that ``fill(rows, trees)`` makes from its rows and trees."""
    schema = T.StructType([*features.schema.fields, *added])

    def apply(rows: pa.Table, model: pa.Table) -> pa.Table:
        model = model.sort_by("tree").to_pylist()
        if rows.num_rows:
            made = fill({c: _numbers(rows, c) for c in {f for t in model for f in t["features"]}}, model, rows)
        else:
            made = [[] for _ in added]
        for field, values in zip(added, made):
            rows = rows.append_column(field.name, pa.array(values, _arrow_type(field.dataType)))
        return rows

    return _dealt(features, keys).groupBy(*keys).cogroup(_dealt(trees, keys).groupBy(*keys)).applyInArrow(apply, schema)


def predict_trees(trees: DataFrame, features: DataFrame, keys=KEYS, name: str = "residual_pred") -> DataFrame:
    """Adds the prediction of each key's model; NULL for a key without one."""
    def fill(columns, model, rows):
        if not model:
            return [[None] * rows.num_rows]
        out = np.full(rows.num_rows, model[0]["base"])
        for t in model:
            out += np.asarray(t["leaves"])[leaf_of(columns, t["features"], t["cuts"], rows.num_rows)]
        return [out]

    return _with_models(features, trees, keys, [T.StructField(name, T.DoubleType())], fill)


def split_importance(trees: DataFrame, by=()) -> DataFrame:
    """(by, feature, importance): share of all gain that the questions about a feature brought; features never asked are absent."""
    gains = trees.select(*by, F.explode(F.arrays_zip("features", "gains")).alias("_s")).groupBy(*by, F.col("_s.features").alias("feature")).agg(F.sum("_s.gains").alias("gain"))
    total = gains.groupBy(*by).agg(F.sum("gain").alias("_all"))
    joined = gains.join(total, list(by)) if by else gains.crossJoin(F.broadcast(total))  # the total is one row
    return joined.select(*by, "feature", (F.col("gain") / F.col("_all")).alias("importance"))


def shapley_values(trees: DataFrame, features: DataFrame, columns=ALL_FEATURES, keys=KEYS) -> DataFrame:
    """Adds ``base_value``, ``prediction`` and ``effects``, an array in the order of ``columns``: prediction = base_value + sum of effects, row by row."""
    columns = list(columns)

    def fill(values, model, rows):
        n = rows.num_rows
        if not model:
            return [[None] * n] * 3
        mean, pred, effects = model[0]["base"], np.full(n, model[0]["base"]), np.zeros((n, len(columns)))
        for t in model:
            node = leaf_of(values, t["features"], t["cuts"], n)
            leaves, covers = np.asarray(t["leaves"]), np.asarray(t["covers"])
            mean += float(leaves @ covers / covers.sum())
            pred += leaves[node]
            names, table = leaf_effects(t["features"], leaves, covers)
            for i, name in enumerate(names):
                effects[:, columns.index(name)] += table[node, i]
        return [np.full(n, mean), pred, list(effects)]

    double = T.DoubleType()
    return _with_models(features, trees, keys, [T.StructField("base_value", double), T.StructField("prediction", double),
                                                T.StructField("effects", T.ArrayType(double))], fill)


def shapley_importance(explained: DataFrame, columns=ALL_FEATURES, by=()) -> DataFrame:
    """(by, feature, mean_effect, mean_abs_effect) over the rows of ``shapley_values``."""
    names = F.array(*map(F.lit, columns))
    long = explained.select(*by, F.explode(F.arrays_zip(names.alias("feature"), "effects")).alias("_e"))
    return long.groupBy(*by, F.col("_e.feature").alias("feature")).agg(F.avg("_e.effects").alias("mean_effect"), F.avg(F.abs("_e.effects")).alias("mean_abs_effect"))


def shuffled_errors(trees: DataFrame, features: DataFrame, label: str, columns=ALL_FEATURES, seed: int = 42, keys=KEYS) -> DataFrame:
    """(feature, n, base_mae, permuted_mae, delta_mae): rise in mean absolute error when a feature is shuffled among the days of its series (seeded)."""
    columns = list(columns)

    def fill(values, model, rows):
        n = rows.num_rows
        y = _numbers(rows, "_y")
        total = lambda cols: sum((np.asarray(t["leaves"])[leaf_of(cols, t["features"], t["cuts"], n)] for t in model), np.full(n, model[0]["base"]))
        if not model:
            return [[None] * n] * 2
        order = np.argsort(np.asarray(rows.column("_day")))
        out = np.zeros((n, len(columns)))
        for j, c in enumerate(columns):
            if c in values:
                moved = np.empty(n)
                moved[order] = values[c][order][np.random.default_rng([seed, j]).permutation(n)]
                out[:, j] = np.abs(y - total({**values, c: moved}))
            else:
                out[:, j] = np.abs(y - total(values))
        return [np.abs(y - total(values)), list(out)]

    rows = features.where(F.col(label).isNotNull()).select(*keys, F.unix_date("ds").alias("_day"), F.col(label).cast("double").alias("_y"), *columns)
    double = T.DoubleType()
    errors = _with_models(rows, trees, keys, [T.StructField("own", double), T.StructField("moved", T.ArrayType(double))], fill).where(F.col("own").isNotNull())
    names = F.array(*map(F.lit, columns))
    long = errors.select("own", F.explode(F.arrays_zip(names.alias("feature"), "moved")).alias("_e"))
    out = long.groupBy(F.col("_e.feature").alias("feature")).agg(F.count("*").alias("n"), F.avg("own").alias("base_mae"), F.avg("_e.moved").alias("permuted_mae"))
    return out.withColumn("delta_mae", F.col("permuted_mae") - F.col("base_mae"))
