"""Daily roll-up of an event stream, and early warning on top of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidecast.functions.scalars import pct_change
from tidecast.operators.decisions import warning_zone
from tidecast.session import cut_lineage
from tidecast.sources.bindings import exact_total
from tidecast.sources.schemas import PARQUET_TABLES


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PARQUET_TABLES["events"]).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def utc_instant(ts: Column) -> Column:
    """A zoneless timestamp as the instant with the same UTC reading, whatever the session time zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def daily_rollup(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) of a batch or a stream.

    On a stream, a day's state is dropped once no event older than the watermark can still arrive; later events of that day are dropped as well. In append mode the
    day is emitted then, in update mode whenever it changes.
    """
    instant = events.select(utc_instant(F.col("ts")).alias("at"), "event_type", "value")
    if events.isStreaming:
        instant = instant.withWatermark("at", watermark)
    rolled = instant.groupBy(F.window("at", "1 day"), "event_type").agg(
        F.count("*").alias("n"), exact_total(F.col("value")).alias("total"))
    day = F.to_utc_timestamp(F.col("window.start"), F.current_timezone()).cast("date")
    return rolled.select(day.alias("day"), "event_type", "n", "total")


def day_change(rolled: DataFrame, reference: DataFrame, days: int = 7) -> DataFrame:
    """Count of each day against the count ``days`` earlier, with its warning zone.

    ``reference`` is a static roll-up: one row per day and type.
    """
    ref = reference.select(F.date_add("day", days).alias("day"), "event_type", F.col("n").alias("n_reference"))
    joined = rolled.join(ref, ["day", "event_type"])
    return warning_zone(joined.withColumn("change_pct", pct_change(F.col("n"), F.col("n_reference"))), "change_pct")


def run_available(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything that is available in append mode, then stop, and return what the Parquet sink holds (files are committed exactly once)."""
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{path}-progress"
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


Step = Callable[[DataFrame, int], dict[str, DataFrame]]


def run_logged(stream: DataFrame, folder: str, step: Step, checkpoint: str | None = None) -> None:
    """Process everything that is available in update mode; ``step(batch, batch_id)`` names the tables to log.

    Each table of a batch is a folder of its own, named by the batch id and overwritten as a whole. A batch that runs again after a failure, even with another content, leaves
    exactly what its last run wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        for name, table in step(batch, batch_id).items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")

    checkpoint = checkpoint or f"{folder}/progress"
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def logged(spark: SparkSession, folder: str, name: str, schema, keys, before: int | None = None) -> DataFrame:
    """The last version of every row of a log, by its keys; with ``before``, as it was when that batch began."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    values = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}") for c in values])


DAY = ("day", "event_type")


def rollup_log(events: DataFrame, folder: str, **options) -> DataFrame:
    """Daily roll-up of a stream, kept as a log of changed days."""
    rolled = daily_rollup(events)
    run_logged(rolled, folder, lambda batch, _: {"days": batch}, **options)
    return logged(events.sparkSession, folder, "days", rolled.schema, DAY)


def warning_log(events: DataFrame, folder: str, days: int = 7, **options) -> DataFrame:
    """Early warning as it arrives: each batch compares its changed days, and the days that refer to them, with the log of all days so far.

    The reference comes from the log of earlier batches and the batch itself, never from events that have not arrived.
    """
    rolled, spark = daily_rollup(events), events.sparkSession

    def step(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        batch = cut_lineage(batch)
        known = batch
        if batch_id:
            old = logged(spark, folder, "days", rolled.schema, DAY, before=batch_id)
            known = batch.unionByName(old.join(batch, list(DAY), "left_anti"))
        touched = batch.select(*DAY).unionByName(batch.select(F.date_add("day", days).alias("day"), "event_type")).distinct()
        return {"days": batch, "warnings": day_change(known.join(touched, list(DAY), "left_semi"), known, days)}

    run_logged(rolled, folder, step, **options)
    schema = day_change(spark.createDataFrame([], rolled.schema), spark.createDataFrame([], rolled.schema), days).schema
    return logged(spark, folder, "warnings", schema, DAY)


def deliver(events: DataFrame, folder: str, delivery: Column) -> None:
    """Write events as one Parquet folder per delivery number, in order, as if they arrived so. There are as many deliveries as the calendar has periods."""
    numbered = cut_lineage(events.withColumn("_delivery", delivery))
    for r in numbered.select("_delivery").distinct().orderBy("_delivery").collect():
        numbered.where(F.col("_delivery") == r[0]).drop("_delivery").coalesce(1).write.parquet(f"{folder}/delivery-{r[0]:05d}")
