"""What the operators share: table scans, word rule, hold-out rule, Arrow maps and a cache that outlives a task."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidecast.session import shared_folder

#: A word is a run of anything but ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def scan(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """One output batch per Arrow batch; ``fn`` returns the columns in schema order."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fn(batch)], names)

    return df.mapInArrow(run, schema)


def row_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most about ``size`` bytes of text in a column, at least one row each: what is worked out for a slice is bounded by its text, not by its rows."""
    for batch in batches:
        at = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()))
        k = 0
        while k < batch.num_rows:
            n = max(1, int(np.searchsorted(at, at[k] + size, side="right")) - 1 - k)
            yield batch.slice(k, n)
            k += n


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept by the Python worker between tasks. Task functions travel by value, so a module global would be
    made anew for each task. A worker keeps the last one only: those of earlier stages are not needed again."""
    holder = sys.modules.setdefault("_tidecast_worker", types.ModuleType("_tidecast_worker"))
    if not hasattr(holder, name):
        drop_worker_cache()
        setattr(holder, name, make())
    return getattr(holder, name)


def drop_worker_cache() -> None:
    """Frees what ``worker_cache`` keeps in this Python worker; for task functions that need the room themselves."""
    holder = sys.modules.get("_tidecast_worker")
    for name in [x for x in vars(holder or object) if not x.startswith("__")]:
        delattr(holder, name)
    pa.default_memory_pool().release_unused()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
