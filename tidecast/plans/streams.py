"""Streaming queries, run over all available events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecast.functions.scalars import settle
from tidecast.plans.registry import query, settled as R
from tidecast.session import shared_folder
from tidecast.sources.tables import read_parquet
from tidecast.streaming import rollup as ru

ROLL = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_daily_rollup", ROLL)
def stream_daily_rollup(spark, sf):
    """Changed days of every batch in a log; the watermark evicts their state."""
    return ru.rollup_log(ru.event_stream(spark, sf), _folder(spark, "rollup"))


ZONES = f"""SELECT day, event_type, n, n_reference, {R('change_pct', 5)} AS change_pct, CASE WHEN change_pct >= -10 THEN 'green' WHEN change_pct >= -20 THEN 'yellow' ELSE 'red' END AS zone FROM c"""
CHANGE = "c AS (SELECT a.day, a.event_type, a.n, b.n AS n_reference, (a.n - b.n) * 100.0 / b.n AS change_pct FROM r a JOIN r b ON b.event_type = a.event_type AND b.day = a.day - 7)"


@query("stream_early_warning", f"""WITH r AS ({ROLL}), {CHANGE} {ZONES}""")
def stream_early_warning(spark, sf):
    """Today's count against seven days before (the events span thirty days), classified as it arrives."""
    out = ru.warning_log(ru.event_stream(spark, sf), _folder(spark, "warnings"))
    return out.select("day", "event_type", "n", "n_reference", settle(F.col("change_pct"), 5).alias("change_pct"), "zone")


# Deliveries of five days each; every 25th event arrives two deliveries late. An event is dropped if its day had ended by the watermark of the batch before.
DELIVERED = """d AS (SELECT *, CAST(ts AS DATE) AS day, datediff('day', min(CAST(ts AS DATE)) OVER (), CAST(ts AS DATE)) // 5 + CASE WHEN event_id % 25 = 7 THEN 2 ELSE 0 END AS delivery FROM events),
    b AS (SELECT delivery, max(ts) AS top FROM d GROUP BY 1),
    w AS (SELECT delivery, max(top) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 DAY AS mark FROM b),
    kept AS (SELECT d.* FROM d JOIN w USING (delivery) WHERE w.mark IS NULL OR d.day + 1 > w.mark)"""


def _delivered(spark, sf):
    """The event stream as deliveries in order of arrival."""
    events = read_parquet(spark, sf, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    placed = events.crossJoin(F.broadcast(first))  # one row
    late = F.when(F.pmod("event_id", F.lit(25)) == 7, 2).otherwise(0)
    folder = _folder(spark, "deliveries")
    ru.deliver(placed, folder, F.floor(F.datediff(F.to_date("ts"), "first") / 5) + late)
    return ru.event_stream(spark, f"{folder}/*", "*.parquet", files_per_batch=1)


@query("stream_closed_days", f"""WITH {DELIVERED} SELECT day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM kept
    WHERE day + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM d) GROUP BY 1, 2""")
def stream_closed_days(spark, sf):
    """Days that the watermark closed, appended once each; events that come after their day was closed are dropped."""
    return ru.run_available(ru.daily_rollup(_delivered(spark, sf)), _folder(spark, "closed"))


@query("stream_warning_deliveries", f"""WITH {DELIVERED}, r AS (SELECT day, event_type, count(*) AS n FROM kept GROUP BY 1, 2), {CHANGE} {ZONES}""")
def stream_warning_deliveries(spark, sf):
    """Early warning over deliveries: each batch refers to days of earlier batches, and days that change later are judged again."""
    out = ru.warning_log(_delivered(spark, sf), _folder(spark, "warnings"))
    return out.select("day", "event_type", "n", "n_reference", settle(F.col("change_pct"), 5).alias("change_pct"), "zone")
