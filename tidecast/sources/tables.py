"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecast.session import cut_lineage
from tidecast.sources.schemas import CSV_TABLES, PARQUET_TABLES


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A retail input table from CSV, with its declared schema and ISO dates."""
    return (spark.read.schema(CSV_TABLES[table]).option("header", True).option("dateFormat", "yyyy-MM-dd")
            .csv(path))


def scan_csv(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of an input table from CSV.

    A line is bad if a field does not parse as its declared type (a date must be yyyy-MM-dd) or the number of fields is wrong; it is kept as text in ``line``. The
    file is parsed whole and once, into the shared folder: a scan of a few columns would not see that another one is bad.
    """
    schema = CSV_TABLES[table] + ", line STRING"
    rows = (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "line").option("enforceSchema", False).csv(path))
    rows = cut_lineage(rows)
    return rows.where(F.col("line").isNull()).drop("line"), rows.where(F.col("line").isNotNull()).select("line")


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(PARQUET_TABLES[table]).parquet(f"{folder}/{table}.parquet")


def write_csv(df: DataFrame, path: str, columns, order=("ds",)) -> None:
    """CSV with header in a fixed column order, globally sorted by range partitions (no single writer task)."""
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, keys=("series_id",), ds: str = "ds") -> None:
    """Parquet partitioned by year. Range partitions on day and series keep every task and file of similar size, however
    many series a day has, and leave tight date statistics for pruning."""
    (df.withColumn("year", F.year(ds)).repartitionByRange("year", ds, *keys).sortWithinPartitions("year", ds, *keys)
       .write.mode("overwrite").partitionBy("year").parquet(path))
