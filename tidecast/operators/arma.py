"""Autoregression with moving-average terms on differences, by two stages of least squares.

Stage one fits a long autoregression, whose residuals stand for the unseen shocks; stage two regresses each difference on its own lags and those of the shocks, and repeats with the
shocks of its own recursion. Differs from a maximum-likelihood fit only in the estimator. The forecast runs the recursion with future shocks at zero. A series has one row per calendar
day and is one group; folds and targets are further keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidecast.operators.spine import KEYS


@dataclass(frozen=True)
class ArmaOrder:
    ar: int = 5
    differences: int = 1
    ma: int = 2
    long_ar: int = 30
    repeats: int = 5


def lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns x[t-1] … x[t-lags] for t from ``start`` on."""
    return np.column_stack([x[start - k:len(x) - k] for k in range(1, lags + 1)]) if lags else np.empty((len(x) - start, 0))


def shocks_of(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step errors of the recursion, with earlier values and shocks at zero."""
    e, p, q = np.zeros(len(d)), len(phi), len(theta)
    padded = np.concatenate([np.zeros(p), d])
    regular = d - sum((phi[k] * padded[p - 1 - k:p - 1 - k + len(d)] for k in range(p)), np.zeros(len(d)))
    for t in range(len(d)):
        e[t] = regular[t] - sum(theta[k] * e[t - 1 - k] for k in range(min(q, t)))
    return e


def stable(theta: np.ndarray) -> bool:
    """Shocks can be worked out from values: all roots of the moving-average part are inside the unit circle."""
    return not len(theta) or bool((np.abs(np.roots(np.r_[1.0, theta])) < 0.999).all())


def fit_arma(d: np.ndarray, order: ArmaOrder) -> tuple[np.ndarray, np.ndarray]:
    """(phi, theta); an autoregression alone where the moving-average part cannot be inverted, zeros where the series is too short."""
    p, q, long = order.ar, order.ma, min(order.long_ar, len(d) // 4)
    if len(d) <= 2 * (p + q) + long or not d.any():
        return np.zeros(p), np.zeros(q)
    solve = lambda x, y: np.linalg.lstsq(x, y, rcond=None)[0]
    x = lagged(d, long, long)
    e = np.concatenate([np.zeros(long), d[long:] - x @ solve(x, d[long:])])
    start, best = long + max(p, q), None
    for _ in range(1 + order.repeats):
        x = np.hstack([lagged(d, p, start), lagged(e, q, start)])
        b = solve(x, d[start:])
        phi, theta = b[:p], b[p:]
        if not stable(theta):
            break
        e = shocks_of(d, phi, theta)
        error = float((e[start:] ** 2).sum())
        if best is not None and error >= best[0]:
            break
        best = (error, phi, theta)
    if best is None:
        x = lagged(d, p, p)
        return solve(x, d[p:]), np.zeros(q)
    return best[1], best[2]


def extend(y: np.ndarray, steps: int, phi: np.ndarray, theta: np.ndarray, differences: int) -> np.ndarray:
    """The recursion beyond the last value, summed back to levels."""
    levels = [y]
    for _ in range(differences):
        levels.append(np.diff(levels[-1]))
    d = levels[-1]
    e = shocks_of(d, phi, theta)
    values, shocks = list(d[-len(phi):]) if len(phi) else [], list(e[-len(theta):]) if len(theta) else []
    path = []
    for _ in range(steps):
        value = sum(c * v for c, v in zip(phi, reversed(values))) + sum(c * v for c, v in zip(theta, reversed(shocks)))
        path.append(value)
        values, shocks = (values + [value])[-len(phi):] if len(phi) else [], (shocks + [0.0])[-len(theta):] if len(theta) else []
    out = np.array(path)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    return out


def _groups(panel: DataFrame, col: str, train_end: str, keys) -> DataFrame:
    rows = panel.where((F.col("ds") <= F.to_date(F.lit(train_end))) & F.col(col).isNotNull())
    return rows.select(*keys, F.unix_date("ds").alias("_day"), F.col(col).cast("double").alias("_y")).repartition(*keys).groupBy(*keys)


def arma_coefficients(panel: DataFrame, col: str, train_end: str, order: ArmaOrder = ArmaOrder(), keys=KEYS) -> DataFrame:
    """(keys, n, phi, theta, sigma): coefficients per series and the deviation of the one-step errors."""
    schema = T.StructType([*(panel.schema[k] for k in keys), *T._parse_datatype_string("n bigint, phi array<double>, theta array<double>, sigma double").fields])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        y = table.sort_by("_day").column("_y").to_numpy()
        d = np.diff(y, order.differences)
        phi, theta = fit_arma(d, order)
        e = shocks_of(d, phi, theta)
        values = [*([k.as_py()] for k in key), [len(y)], [phi.tolist()], [theta.tolist()], [float(np.std(e)) if len(e) else None]]
        kinds = [*(table.schema.field(k).type for k in keys), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], schema.names)

    return _groups(panel, col, train_end, keys).applyInArrow(fit, schema)


def arma_forecast(panel: DataFrame, col: str, train_end: str, horizon_end: str, order: ArmaOrder = ArmaOrder(), keys=KEYS) -> DataFrame:
    """(keys, ds, pred) from the day after each series' last value to ``horizon_end``."""
    schema = T.StructType([*(panel.schema[k] for k in keys), T.StructField("ds", T.DateType()), T.StructField("pred", T.DoubleType())])
    last = int((np.datetime64(horizon_end) - np.datetime64("1970-01-01")).astype(int))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_day")
        y, day = table.column("_y").to_numpy(), int(table.column("_day")[-1].as_py())
        steps = max(0, last - day)
        phi, theta = fit_arma(np.diff(y, order.differences), order)
        values = [*([k.as_py()] * steps for k in key), np.arange(day + 1, day + 1 + steps, dtype=np.int32), extend(y, steps, phi, theta, order.differences)]
        kinds = [*(table.schema.field(k).type for k in keys), pa.date32(), pa.float64()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], schema.names)

    return _groups(panel, col, train_end, keys).applyInArrow(run, schema)
