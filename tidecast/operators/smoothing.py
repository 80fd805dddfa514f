"""Seasonal decomposition by locally weighted regression, robust against outliers.

An inner loop smooths the values of each season place over the years, takes out what is left of the level, and smooths the deseasonalised series into a trend. An outer loop
weighs every day down by the size of its remainder (bisquare), so an outlier moves neither. A series has one row per calendar day and is one group.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidecast.operators.spine import KEYS


def line_weights(weight: np.ndarray, window: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, shares): the straight-line fit at each place of ``at`` (all by default) to the ``window`` nearest of evenly spaced values is the sum of shares times values.

    Tricube weights by distance, times ``weight``. With fewer values than the window, all are used, and the reach grows by half of what is missing. ``weight`` may hold several
    series as rows; a place without any weight near it falls back on distance alone.
    """
    n = weight.shape[-1]
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    width = min(window, n)
    first = np.clip(np.round(at).astype(int) - (width - 1) // 2, 0, n - width)
    near = first[:, None] + np.arange(width)
    gap = near - at[:, None]
    reach = np.maximum(np.abs(gap).max(1), 0.5) + max(0, window - n) // 2
    close = np.clip(1 - (np.abs(gap) / reach[:, None]) ** 3, 0.0, 1.0) ** 3
    w = close * weight[..., near]
    total = w.sum(-1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1.0), close / close.sum(1, keepdims=True))
    off = gap - (w * gap).sum(-1, keepdims=True)
    spread = (w * off ** 2).sum(-1, keepdims=True)
    slope = np.where(spread > (0.001 * (n - 1)) ** 2, (off - gap) / np.where(spread > 0, spread, 1.0), 0.0)
    return near, w * (1 + slope * off)


def local_line(y: np.ndarray, weight: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """Locally weighted straight-line fits to one series or to several as rows."""
    near, share = line_weights(weight, window, at)
    return (share * y[..., near]).sum(-1)


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], x]))
    return (total[width:] - total[:-width]) / width


def odd_above(x: float) -> int:
    n = ceil(x)
    return n if n % 2 else n + 1


def bisquare(rest: np.ndarray) -> np.ndarray:
    bound = 6 * np.median(np.abs(rest))
    return np.clip(1 - (rest / bound) ** 2, 0.0, 1.0) ** 2 if bound > 0 else (rest == 0).astype(float)


def first_weights(y: np.ndarray, period: int) -> np.ndarray:
    """Weights from medians, of a year around each day and of each season place, so that an outlier does not pull down the days it is compared with."""
    n, half = len(y), period // 2
    around = np.lib.stride_tricks.sliding_window_view(y, 2 * half + 1)
    level = y - np.median(around, axis=1)[np.clip(np.arange(n) - half, 0, n - 2 * half - 1)]
    padded = np.full((ceil(n / period), period), np.nan)
    padded.reshape(-1)[:n] = level
    return bisquare(level - np.nanmedian(padded, axis=0)[np.arange(n) % period])


def decompose(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, weight) of a series of at least two periods."""
    n, years = len(y), ceil(len(y) / period)
    trend_window = odd_above(1.5 * period / (1 - 1.5 / seasonal))
    low_near, low_share = line_weights(np.ones(n), odd_above(period + 1))
    full = n - (years - 1) * period                                  # places that occur in the last, incomplete period
    groups = [(p[:, None] + period * np.arange(k), p[:, None] + period * np.arange(k + 2), np.arange(-1, k + 1))
              for p, k in ((np.arange(full), years), (np.arange(full, period), years - 1)) if len(p)]
    weight, trend = first_weights(y, period), np.zeros(n)
    for _ in range(outer + 1):
        trend_near, trend_share = line_weights(weight, trend_window)
        cycles = [(at, to, *line_weights(weight[at], seasonal, ends)) for at, to, ends in groups]
        for _ in range(inner):
            level, cycle = y - trend, np.zeros((years + 2) * period)
            for at, to, near, share in cycles:
                cycle[to] = (share * level[at][:, near]).sum(-1)
            cycle = cycle[:n + 2 * period]
            low = moving_mean(moving_mean(moving_mean(cycle, period), period), 3)
            season = cycle[period:period + n] - (low_share * low[low_near]).sum(-1)
            trend = (trend_share * (y - season)[trend_near]).sum(-1)
        weight = bisquare(y - trend - season)
    return trend, season, weight


def robust_decompose(df: DataFrame, col: str, period: int = 365, keys=KEYS, **options) -> DataFrame:
    """Adds trend, seasonal, residual and the robustness weight of each day; NULL for series of less than two periods. ``df`` has every day of a series, without gaps."""
    double = T.DoubleType()
    names = ("trend", "seasonal", "residual", "weight")
    rows = df.select(*keys, "ds", F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, double) for n in names)])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("ds")
        y = table.column(col).to_numpy()
        if len(y) < 2 * period:
            made = [pa.nulls(len(y), pa.float64())] * 4
        else:
            trend, season, weight = decompose(y, period, **options)
            made = [trend, season, y - trend - season, weight]
        for name, values in zip(names, made):
            table = table.append_column(name, pa.array(values, pa.float64()))
        return table

    return rows.repartition(*keys).groupBy(*keys).applyInArrow(fill, schema)
