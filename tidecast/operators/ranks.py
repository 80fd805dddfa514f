"""Average ranks, quantiles and running shares: by window on groups that the calendar bounds, by distributed prefix sums on raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.session import cut_lineage


def average_rank(x: Column, group) -> Column:
    """Average rank inside groups that the calendar bounds (daily series). Ties share the mean of their places."""
    place = F.rank().over(W.partitionBy(*group).orderBy(x))
    ties = F.count("*").over(W.partitionBy(*group, x))
    return place + (ties - 1) / 2


def ranged(rows: DataFrame, group, order, ranges: int | None = None) -> DataFrame:
    """The rows in key ranges of about equal size, with the number of the range as ``_range``.

    Ranges follow (group, order), so a group of any size spans as many ranges as it needs, and rows with equal keys share one. The layout is written out: a sampled boundary that a
    replayed task chose anew would move rows between ranges.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()))


def range_offsets(rows: DataFrame, group, total: Column) -> DataFrame:
    """(group, _range, _before, _all): ``total`` of the group's earlier ranges and of the whole group. A group has at most one row per range here."""
    sums = rows.groupBy(*group, "_range").agg(total.alias("_t"))
    whole = W.partitionBy(*(group or [F.lit(1)]))
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*group, "_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"), F.sum("_t").over(whole).alias("_all"))


def cumulative_counts(counts: DataFrame, group, value: str = "value", n: str = "n", ranges: int | None = None) -> DataFrame:
    """Adds ``before`` (rows with a smaller value in the group), ``ties`` (rows that share the value) and ``_size`` (rows of the group).

    ``counts`` has one row per (group, value) or a few (one per level), so a value shared by a third of all rows is still that
    small here. Running counts are taken inside key ranges, and the totals of the earlier ranges are added back: no group and no list of values is in one task.
    """
    group = list(group)
    placed = ranged(counts, group, [F.col(value)], ranges)
    inside = W.partitionBy(*group, "_range")
    upto = F.sum(n).over(inside.orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    ties = F.sum(n).over(W.partitionBy(*group, "_range", value))
    keys = [*group, "_range"]
    joined = placed.select("*", upto.alias("_upto"), ties.alias("ties")).join(range_offsets(placed, group, F.sum(n)), keys)
    return joined.select(*counts.columns, (F.col("_before") + F.col("_upto") - F.col("ties")).alias("before"), "ties", F.col("_all").alias("_size"))


def running_share(rows: DataFrame, label: str, value: str, group=(), ranges: int | None = None) -> DataFrame:
    """Adds ``_total`` (of the group) and ``_running`` (sum down to the row, greatest value first, ties by label)."""
    group = list(group)
    order = [F.col(value).desc(), F.col(label)]
    placed = ranged(rows, group, order, ranges)
    upto = F.sum(value).over(W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = placed.withColumn("_upto", upto).join(range_offsets(placed, group, F.sum(value)), [*group, "_range"])
    return joined.select(*rows.columns, F.col("_all").alias("_total"), (F.col("_before") + F.col("_upto")).alias("_running"))


def histogram_ranks(counts: DataFrame, group, value: str = "value", n: str = "n", ranges: int | None = None) -> DataFrame:
    """Adds ``ties`` and the average rank of every value, from row counts (see ``cumulative_counts``)."""
    placed = cumulative_counts(counts, group, value, n, ranges)
    return placed.select(*counts.columns, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"))


def histogram_quantiles(counts: DataFrame, group, quantiles: dict[str, float], value: str = "value", n: str = "n",
                        ranges: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of groups of any size, one column per entry of ``quantiles``.

    Position (N − 1)·q falls between two places of the sorted rows; the values that cover those places are picked by their
    cumulative counts, so nothing is collected.
    """
    placed = cumulative_counts(counts, group, value, n, ranges)
    first, after = F.col("before"), F.col("before") + F.col("ties")

    def at(place: Column) -> Column:
        return F.max(F.when((place >= first) & (place < after), F.col(value)))

    aggs = []
    for name, q in quantiles.items():
        spot = (F.col("_size") - 1) * q
        aggs += [at(F.floor(spot)).alias(f"_l_{name}"), at(F.ceil(spot)).alias(f"_u_{name}"),
                 F.max(spot - F.floor(spot)).alias(f"_w_{name}")]
    picked = placed.groupBy(*group).agg(*aggs)
    return picked.select(*group, *[
        (F.col(f"_l_{k}") + (F.col(f"_u_{k}") - F.col(f"_l_{k}")) * F.col(f"_w_{k}")).alias(k) for k in quantiles])
