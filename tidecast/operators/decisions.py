"""Decision tables for finance, supply chain, marketing and early warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.fixed_values import BAND_MULTIPLIER, BUDGET_SHARES, WARNING_ZONES
from tidecast.functions.calendar import month_label, quarter_label
from tidecast.functions.scalars import margin_pct, ratio
from tidecast.operators.spine import KEYS
from tidecast.operators.windows import yoy_change


def buffer_tradeoff(errors: DataFrame, error: str = "error", top: int = 30, keys=KEYS) -> DataFrame:
    """Stock-out rate and mean excess stock for buffers 0…``top`` percent.

    Each series is aggregated once with an array of all buffer levels; the error rows are not multiplied.
    """
    levels = range(top + 1)
    e = F.col(error)
    aggs = []
    for b in levels:
        buf = b / 100
        aggs += [(F.avg((e > buf).cast("int")) * 100).alias(f"_s{b}"),
                 (F.avg(F.greatest(buf - e, F.lit(0.0))) * 100).alias(f"_x{b}")]
    wide = errors.where(e.isNotNull()).groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).alias("buffer_pct"), F.col(f"_s{b}").alias("stockout_pct"),
                              F.col(f"_x{b}").alias("excess_pct")) for b in levels])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def month_end_risk(errors: DataFrame, error: str = "error", from_day: int = 25, keys=KEYS) -> DataFrame:
    late = F.dayofmonth("ds") >= from_day
    e = F.col(error)
    def share(cond: Column, limit: float) -> Column:
        return F.avg(F.when(cond, (e > limit).cast("int"))) * 100
    return errors.where(e.isNotNull()).groupBy(*keys).agg(
        share(~late, 0.15).alias("mid_risk_15"), share(late, 0.15).alias("end_risk_15"),
        share(late, 0.20).alias("end_risk_20"))


def marketing_allocation(sales: DataFrame, traffic: DataFrame, keys=KEYS) -> DataFrame:
    """Quarter score = mean margin % × mean revenue per session, as softmax shares of the standardised score.

    ``traffic`` is (ds, sessions), one row per calendar day and so broadcast; sales outside its days are left out.
    """
    joined = sales.join(F.broadcast(traffic), "ds").where(F.col("revenue").isNotNull())
    q = joined.groupBy(*keys, F.quarter("ds").alias("quarter")).agg(
        F.avg(margin_pct(F.col("revenue"), F.col("cogs"))).alias("margin_pct"),
        F.avg(ratio(F.col("revenue"), F.col("sessions"))).alias("revenue_per_session"))
    whole = W.partitionBy(*keys)  # four rows per series
    scored = q.withColumn("score", F.col("margin_pct") * F.col("revenue_per_session"))
    scored = scored.withColumn("_z", ratio(F.col("score") - F.avg("score").over(whole), F.stddev_samp("score").over(whole)))
    scored = scored.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(whole)))
    return scored.withColumn("share_pct", F.col("_e") / F.sum("_e").over(whole) * 100).drop("_z", "_e")


def early_warning_points(sales: DataFrame, traffic: DataFrame, keys=KEYS) -> DataFrame:
    """Traffic change vs revenue change against the same day last year, with a zone per day."""
    joined = sales.join(F.broadcast(traffic), "ds", "left").select(*keys, "ds", "revenue", "sessions")
    out = joined.select(*keys, "ds", yoy_change(F.col("sessions"), 365, keys).alias("traffic_yoy"),
                        yoy_change(F.col("revenue"), 365, keys).alias("revenue_yoy"))
    t, r = F.col("traffic_yoy"), F.col("revenue_yoy")
    zone = F.when((t > 0) & (r > 0), "green").when(t < -20, "red").otherwise("yellow")
    return out.where(t.isNotNull()).withColumn("zone", zone)


def zone_expression(yoy: Column, field: int) -> Column:
    """CASE over the fixed zone table; ``field`` 1 is the zone, 2 the probability, 3 the action."""
    *bounded, (_, *rest) = WARNING_ZONES
    expr = None
    for low, *values in bounded:
        cond, value = yoy >= low, values[field - 1]
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return F.when(yoy.isNotNull(), expr.otherwise(rest[field - 1]))


def warning_zone(df: DataFrame, yoy: str = "traffic_yoy") -> DataFrame:
    y = F.col(yoy)
    return (df.withColumn("zone", zone_expression(y, 1)).withColumn("probability", zone_expression(y, 2))
              .withColumn("action", zone_expression(y, 3)))


def quarter_plan(forecast: DataFrame, keys=KEYS) -> DataFrame:
    q = forecast.groupBy(*keys, quarter_label(F.col("ds")).alias("period")).agg(
        F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs"))
    return (q.withColumn("profit", F.col("revenue") - F.col("cogs"))
             .withColumn("margin_pct", margin_pct(F.col("revenue"), F.col("cogs"))))


def stock_plan(forecast: DataFrame, buffer_pct: int = 15, keys=KEYS) -> DataFrame:
    m = forecast.groupBy(*keys, month_label(F.col("ds")).alias("period")).agg(F.sum("revenue").alias("revenue"))
    return m.withColumn("stock_target", F.col("revenue") * (1 + buffer_pct / 100))


def budget_split(quarters: DataFrame, budget: str, quarter: str = "quarter") -> DataFrame:
    """Annual budget × fixed share of the quarter."""
    label = F.concat(F.lit("Q"), F.col(quarter).cast("string"))
    share = None
    for q, pct in BUDGET_SHARES.items():
        share = F.when(label == q, pct) if share is None else share.when(label == q, pct)
    return quarters.withColumn("share_pct", share).withColumn("quarter_budget", F.col(budget) * F.col("share_pct") / 100)


def clearance_audit(forecast: DataFrame, keys=KEYS) -> DataFrame:
    """Days with cost above revenue, their share, and the months they fall in."""
    loss = F.col("cogs") > F.col("revenue")
    return forecast.groupBy(*keys).agg(
        F.count_if(loss).alias("loss_days"), (F.avg(loss.cast("int")) * 100).alias("loss_pct"),
        F.countDistinct(F.when(loss, month_label(F.col("ds")))).alias("loss_months"))


def forecast_band(forecast: DataFrame, col: str = "revenue") -> DataFrame:
    return (forecast.withColumn("upper", F.col(col) * BAND_MULTIPLIER)
                    .withColumn("lower", F.col(col) * (2 - BAND_MULTIPLIER)))
