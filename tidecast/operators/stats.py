"""Statistical screening. Statistics are plain aggregates over ranks; p-values are added to the aggregated rows."""

from __future__ import annotations

from math import ceil, erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidecast.fixed_values import COINTEGRATION_CRITICAL, COINTEGRATION_SURFACE
from tidecast.functions.scalars import correlation, ratio
from tidecast.functions.tails import chi_square_p, correlation_p, normal_p
from tidecast.operators.ranks import average_rank, histogram_ranks
from tidecast.operators.spine import KEYS, by_day
from tidecast.operators.windows import band, centred, rolling_column, shift_rows


def spearman(long: DataFrame, x: str, y: str, group) -> DataFrame:
    """Rank correlation per group of a daily long table; rows with a missing side are left out."""
    pairs = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.select(*group, average_rank(F.col(x), group).alias("_rx"), average_rank(F.col(y), group).alias("_ry"))
    return ranked.groupBy(*group).agg(correlation(F.col("_rx"), F.col("_ry")).alias("r"), F.count("*").alias("n"))


def with_correlation_verdict(df: DataFrame, min_r: float = 0.1, alpha: float = 0.05) -> DataFrame:
    out = df.withColumn("p_value", correlation_p("r", F.col("n").cast("double")))
    return out.withColumn("keep", (F.abs("r") >= min_r) & (F.col("p_value") < alpha))


def mann_whitney(df: DataFrame, y: str, flag: str, group) -> DataFrame:
    """U of the flagged rows, tie-corrected z with continuity, and the median effect in percent."""
    rows = df.where(F.col(y).isNotNull() & F.col(flag).isNotNull())
    ties = F.count("*").over(W.partitionBy(*group, y))
    ranked = rows.select(*group, F.col(y).alias("_y"), F.col(flag).cast("int").alias("_f"),
                         average_rank(F.col(y), group).alias("_r"), ties.cast("double").alias("_t"))
    on, off = F.col("_f") == 1, F.col("_f") == 0
    s = ranked.groupBy(*group).agg(
        F.sum(F.when(on, F.col("_r"))).alias("_r1"), F.count_if(on).cast("double").alias("_n1"),
        F.count_if(off).cast("double").alias("_n2"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"),
        F.median(F.when(on, F.col("_y"))).alias("_m1"), F.median(F.when(off, F.col("_y"))).alias("_m2"))
    n1, n2 = F.col("_n1"), F.col("_n2")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.coalesce(ratio(F.col("_ties"), n * (n - 1)), F.lit(0.0))))
    z = ratio(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    return s.select(*group, n1.cast("bigint").alias("n_flagged"), n2.cast("bigint").alias("n_other"), u.alias("u"),
                    z.alias("z"), (ratio(F.col("_m1") - F.col("_m2"), F.col("_m2")) * 100).alias("effect_pct"))


def _kruskal_from_rank_sums(sums: DataFrame, group, min_size: int) -> DataFrame:
    """``sums``: one row per (group, level) with rank sum, size and tie term share."""
    s = sums.where(F.col("_n") >= min_size).groupBy(*group).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"), F.sum("_n").alias("_m"),
        F.sum("_tie").alias("_ties"), F.count("*").alias("levels"))
    m = F.col("_m")
    raw = 12 / (m * (m + 1)) * F.col("_q") - 3 * (m + 1)
    h = ratio(raw, 1 - ratio(F.col("_ties"), m * m * m - m))
    return s.select(*group, h.alias("h"), "levels", m.cast("bigint").alias("n"))


def kruskal(long: DataFrame, y: str, level: str, group, min_size: int = 2) -> DataFrame:
    """H per group of a daily long table; levels smaller than ``min_size`` are dropped before ranking."""
    rows = long.where(F.col(y).isNotNull() & F.col(level).isNotNull())
    rows = rows.withColumn("_size", F.count("*").over(W.partitionBy(*group, level))).where(F.col("_size") >= min_size)
    ties = F.count("*").over(W.partitionBy(*group, y)).cast("double")
    ranked = rows.select(*group, level, average_rank(F.col(y), group).alias("_rank"), (ties * ties - 1).alias("_t"))
    sums = ranked.groupBy(*group, level).agg(
        F.sum("_rank").alias("_r"), F.count("*").cast("double").alias("_n"), F.sum("_t").alias("_tie"))
    return _kruskal_from_rank_sums(sums, group, min_size)


def kruskal_rows(long: DataFrame, y: str, level: str, group, ranges: int | None = None) -> DataFrame:
    """H on raw rows (one per order): rows are counted per value before any shuffle, then ranked by histogram."""
    rows = long.where(F.col(y).isNotNull() & F.col(level).isNotNull())
    counted = rows.groupBy(*group, F.col(y).alias("value"), level).agg(F.count("*").alias("n"))
    ranked = histogram_ranks(counted, group, ranges=ranges)
    n, ties = F.col("n"), F.col("ties").cast("double")
    sums = ranked.groupBy(*group, level).agg(
        F.sum(n * F.col("avg_rank")).alias("_r"), F.sum(n).cast("double").alias("_n"),
        F.sum(n * (ties * ties - 1)).alias("_tie"))
    return _kruskal_from_rank_sums(sums, group, 1)


def with_group_verdict(df: DataFrame, statistic: str = "h", alpha: float = 0.05) -> DataFrame:
    out = df.withColumn("p_value", chi_square_p(F.col(statistic), (F.col("levels") - 1).cast("double")))
    return out.withColumn("keep", F.col("p_value") < alpha)


def with_z_verdict(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    return df.withColumn("p_value", normal_p("z")).withColumn("keep", F.col("p_value") < alpha)


def cross_correlation(df: DataFrame, x: str, y: str, max_lag: int = 14, keys=KEYS) -> DataFrame:
    """corr(x shifted by lag, y) for every lag, in one window pass and one aggregate.

    The 29 copies of a row are made after the exchange and folded by the partial aggregate before the next one.

    Correlation does not change under standardising, so the raw columns are used.
    """
    lags = range(-max_lag, max_lag + 1)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k + max_lag}").alias("x")) for k in lags])
    wide = df.select(*keys, y, *[shift_rows(F.col(x), k, keys).alias(f"_l{k + max_lag}") for k in lags])
    long = wide.select(*keys, y, F.explode(pairs).alias("_p"))
    return long.groupBy(*keys, F.col("_p.lag").alias("lag")).agg(
        correlation(F.col("_p.x"), F.col(y)).alias("corr"), (1.96 / F.sqrt(F.count("*"))).alias("ci"))


def peak_lag(ccf: DataFrame, keys=KEYS) -> DataFrame:
    """Lag of the highest correlation, the earliest on ties."""
    best = F.max(F.struct("corr", (-F.col("lag")).alias("_neg"))).alias("_b")
    return ccf.groupBy(*keys).agg(best).select(*keys, (-F.col("_b._neg")).alias("peak_lag"), F.col("_b.corr").alias("peak_corr"))


def linear_trend(df: DataFrame, y: str, x: str, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def spread_anomaly(df: DataFrame, y: str = "cogs", x: str = "revenue", window: int = 90, n_sigma: float = 2.0,
                   keys=KEYS) -> DataFrame:
    """y − β·x with β = cov/var (sample over population, no intercept), and its trailing band."""
    whole = W.partitionBy(*keys)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    beta = ratio(F.covar_samp(y, x).over(whole), F.var_pop(x).over(whole))
    out = df.where(both).withColumn("beta", beta).withColumn("spread", F.col(y) - F.col("beta") * F.col(x))
    return band(out, "spread", window, n_sigma, keys)


def cointegration(df: DataFrame, y: str = "revenue", x: str = "cogs", keys=KEYS) -> DataFrame:
    """Residual unit-root test of two series.

    Differs from the automatic-lag test: one lagged difference is fixed, and the statistic is compared with
    published asymptotic critical values in place of an exact p. The residual comes from an ordinary regression of y on x
    with constant; the test regression has two regressors and no constant, so its normal equations are
    five sums per series.
    """
    whole = W.partitionBy(*keys)
    slope, intercept = F.regr_slope(y, x).over(whole), F.regr_intercept(y, x).over(whole)
    e = df.withColumn("_e", F.col(y) - (slope * F.col(x) + intercept))
    e = e.withColumn("_e1", F.lag("_e").over(by_day(keys))).withColumn("_d", F.col("_e") - F.col("_e1"))
    e = e.withColumn("_d1", F.lag("_d").over(by_day(keys))).where(F.col("_d1").isNotNull())
    a, b, d = F.col("_e1"), F.col("_d1"), F.col("_d")
    s = e.groupBy(*keys).agg(
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * d).alias("ad"),
        F.sum(b * d).alias("bd"), F.sum(d * d).alias("dd"), F.count("*").alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("rho", ratio(F.col("ad") * F.col("bb") - F.col("bd") * F.col("ab"), det))
    s = s.withColumn("_g", ratio(F.col("bd") * F.col("aa") - F.col("ad") * F.col("ab"), det))
    rss = F.col("dd") - F.col("rho") * F.col("ad") - F.col("_g") * F.col("bd")
    se = F.sqrt(ratio(rss, F.col("n") - 2) * ratio(F.col("bb"), det))
    out = s.select(*keys, "n", "rho", ratio(F.col("rho"), se).alias("t_stat"))
    return out.withColumn("is_cointegrated", F.col("t_stat") < COINTEGRATION_CRITICAL["5%"])


def nested_errors(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the regressions of the last column on the first 1, 2, … columns, from one factorisation of their Gram matrix."""
    low = np.linalg.cholesky(gram + 1e-12 * np.trace(gram) / len(gram) * np.eye(len(gram)))
    return gram[-1, -1] - np.cumsum(low[-1, :-1] ** 2)


def unit_root(e: np.ndarray, max_lag: int | None = None) -> tuple[int, int, float]:
    """(lag, rows, statistic) of a unit-root test without constant whose number of lagged differences has the lowest information criterion."""
    n = len(e)
    most = max_lag if max_lag is not None else min(ceil(12 * (n / 100) ** 0.25), n // 2 - 1)
    d = np.diff(e)

    def design(lag: int) -> np.ndarray:
        return np.column_stack([e[lag:-1], *(d[lag - k:len(d) - k] for k in range(1, lag + 1)), d[lag:]])

    x = design(most)
    rss = nested_errors(x.T @ x)
    criterion = len(x) * np.log(np.maximum(rss, 1e-300) / len(x)) + 2 * np.arange(1, len(rss) + 1)
    lag = int(np.argmin(criterion))
    x = design(lag)
    gram = x.T @ x
    inverse = np.linalg.pinv(gram[:-1, :-1])
    beta = inverse @ gram[:-1, -1]
    error = gram[-1, -1] - beta @ gram[:-1, -1]
    return lag, len(x), float(beta[0] / np.sqrt(error / (len(x) - lag - 1) * inverse[0, 0]))


def cointegration_auto(df: DataFrame, y: str = "revenue", x: str = "cogs", keys=KEYS) -> DataFrame:
    """(keys, lag, n, t_stat, p_value, is_cointegrated): residual unit-root test with the number of lags chosen by information criterion.

    All shorter regressions come from one factorisation of the Gram matrix of the longest. The p-value is the published response surface for two series with constant.
    """
    whole = W.partitionBy(*keys)
    slope, intercept = F.regr_slope(y, x).over(whole), F.regr_intercept(y, x).over(whole)
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, "ds", (F.col(y) - (slope * F.col(x) + intercept)).alias("_e"))
    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string("lag int, n bigint, t_stat double, p_value double").fields])

    def test(key: tuple, table: pa.Table) -> pa.Table:
        e = table.sort_by("ds").column("_e").to_numpy()
        flat = len(e) < 12 or np.abs(e).max() <= 1e-9
        lag, n, t = (None, len(e), None) if flat else unit_root(e)
        values = [*([k.as_py()] for k in key), [lag], [n], [t], [None if flat else surface_p(t)]]
        kinds = [*(table.schema.field(k).type for k in keys), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], schema.names)

    out = rows.groupBy(*keys).applyInArrow(test, schema)
    return out.withColumn("is_cointegrated", F.col("p_value") < 0.05)


def surface_p(t: float) -> float:
    """Probability of a lower statistic without cointegration, by polynomials under the normal distribution."""
    if t > COINTEGRATION_SURFACE["highest"]:
        return 1.0
    if t < COINTEGRATION_SURFACE["lowest"]:
        return 0.0
    powers = COINTEGRATION_SURFACE["low" if t <= COINTEGRATION_SURFACE["bend"] else "high"]
    return erfc(-sum(c * t ** k for k, c in enumerate(powers)) / sqrt(2)) / 2


def seasonal_decompose(df: DataFrame, col: str, period: int = 365, keys=KEYS) -> DataFrame:
    """Trend, seasonal and residual parts.

    Differs from robust smoothing: the trend is a centred moving average over one period (NULL near the ends),
    the seasonal part is the mean detrended value of each (month, day), centred on zero.
    """
    before, after = centred(period)
    out = df.withColumn("trend", rolling_column(F.col(col), before, after, "mean", period, keys))
    out = out.withColumn("_detrended", F.col(col) - F.col("trend"))
    day = W.partitionBy(*keys, F.month("ds"), F.dayofmonth("ds"))
    centre = F.avg("_detrended").over(W.partitionBy(*keys))
    out = out.withColumn("seasonal", F.avg("_detrended").over(day) - centre).drop("_detrended")
    return out.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal"))


def seasonal_share(parts: DataFrame, col: str, keys=KEYS) -> DataFrame:
    return parts.groupBy(*keys).agg(
        (ratio(F.var_pop("seasonal"), F.var_pop(col)) * 100).alias("seasonal_share_pct"))


def to_levels(df: DataFrame, attributes, y: str) -> DataFrame:
    """Order attributes -> (feature, level, y), one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("feature"), F.col(a).alias("level")) for a in attributes])
    return df.select(F.col(y).alias("y"), F.explode(cells).alias("_c")).select("y", "_c.*")
