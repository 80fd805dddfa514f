"""A third of all rows on one order, part, customer, value and day; every join forced to shuffle. Results stay whole."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import table
from tidecast.plans import catalog

NAMES = ("yoy_accuracy", "join_items_orders", "join_orders_payments", "join_items_products_orders", "category_mix", "daily_traffic",
         "agg_named_multi", "average_rank", "kruskal_wallis_orders", "describe", "cap_outliers", "monthly_to_daily", "marketing_allocation")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skew"))
    hot = F.col("id") % 3 == 0
    spread = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    start = F.lit("1996-01-01").cast("timestamp_ntz")
    plus = lambda days: (F.date_add(start.cast("date"), days.cast("int"))).cast("timestamp_ntz")
    orders = spark.range(6000).select(
        F.col("id").alias("o_orderkey"), F.when(hot, 5).otherwise(spread(1, 400)).cast("bigint").alias("o_custkey"),
        F.element_at(F.array(*map(F.lit, "FOP")), (spread(2, 3) + 1).cast("int")).alias("o_orderstatus"),
        F.when(hot, 5000.0).otherwise(spread(3, 90000) / 7).cast("double").alias("o_totalprice"),
        F.when(hot, start).otherwise(plus(spread(4, 1096))).alias("o_orderdate"),
        F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH"))), (spread(5, 2) + 1).cast("int")).alias("o_orderpriority"))
    lines = spark.range(30000).select(
        F.when(hot, 17).otherwise(spread(6, 6000)).cast("bigint").alias("l_orderkey"),
        F.when(hot, 3).otherwise(spread(7, 200)).cast("bigint").alias("l_partkey"), spread(8, 50).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), (spread(9, 50) + 1).cast("double").alias("l_quantity"),
        (F.round((spread(10, 900000) + 90000) / 100, 2)).alias("l_extendedprice"), (spread(11, 11) / 100).alias("l_discount"),
        F.lit(0.0).alias("l_tax"), F.element_at(F.array(*map(F.lit, "ANR")), (spread(12, 3) + 1).cast("int")).alias("l_returnflag"),
        F.element_at(F.array(*map(F.lit, "FO")), (spread(13, 2) + 1).cast("int")).alias("l_linestatus"),
        plus(spread(14, 1096)).alias("l_shipdate"))
    parts = spark.range(200).select(
        F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"),
        F.element_at(F.array(*map(F.lit, ("ECONOMY", "SMALL"))), (F.col("id") % 2 + 1).cast("int")).alias("p_type"),
        F.lit(1).alias("p_size"), (900 + F.col("id") / 10).alias("p_retailprice"))
    customers = spark.range(400).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"),
        F.element_at(F.array(*map(F.lit, ("AUTO", "HOME"))), (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment"))
    for name, df in (("orders", orders), ("lineitem", lines), ("part", parts), ("customer", customers)):
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_skewed_tables_give_whole_results(spark, skewed, name):
    folder, con = skewed
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        got = catalog.QUERIES[name](spark, folder).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert table(got) == table(con.execute(catalog.ORACLES[name]).df())
    assert len(got)
