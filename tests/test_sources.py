"""CSV scans and sinks, yearly panel files, streaming, session helpers."""

from datetime import date

from pyspark.sql import functions as F

from tests.conftest import SMALL, series
from tidecast.functions.tails import chi_square_upper, normal_two_sided, student_two_sided
from tidecast.session import cut_lineage
from tidecast.sources.tables import read_csv, read_parquet, scan_csv, write_csv, write_panel
from tidecast.streaming import rollup as ru


def test_csv_has_declared_types(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("Date,Revenue,COGS\n2022-01-02,10.5,8\n2022-01-01,,7.25\n")
    df = read_csv(spark, str(tmp_path / "sales.csv"), "sales")
    assert df.dtypes == [("Date", "date"), ("Revenue", "double"), ("COGS", "double")]
    assert [tuple(r) for r in df.orderBy("Date").collect()] == [(date(2022, 1, 1), None, 7.25), (date(2022, 1, 2), 10.5, 8.0)]
    (tmp_path / "promo.csv").write_text(
        "promo_id,promo_name,promo_type,discount_value,start_date,end_date,applicable_category,promo_channel,stackable_flag,min_order_value\n"
        "P1,Spring Sale 2013,percentage,12.0,2013-03-18,2013-04-17,,email,1,0\n")
    row = read_csv(spark, str(tmp_path / "promo.csv"), "promotions").collect()[0]
    assert row["applicable_category"] is None and row["stackable_flag"] == 1 and row["end_date"] == date(2013, 4, 17)


def test_csv_sink_round_trip_in_order(spark, tmp_path):
    df = series(spark, "2020-01-01", [3, 1, 2]).select(F.col("ds").alias("Date"), F.col("revenue").alias("Revenue"), F.lit(1.5).alias("COGS"))
    write_csv(df.repartition(3), str(tmp_path / "out"), ["Date", "Revenue", "COGS"], order=["Date"])
    lines = []
    for f in sorted((tmp_path / "out").glob("part-*.csv")):
        text = f.read_text().splitlines()
        assert text[0] == "Date,Revenue,COGS"
        lines += text[1:]
    assert lines == ["2020-01-01,3.0,1.5", "2020-01-02,1.0,1.5", "2020-01-03,2.0,1.5"]


def test_panel_files_prune_by_year(spark, tmp_path):
    write_panel(series(spark, "2019-12-30", range(5)), str(tmp_path / "panel"))
    back = spark.read.parquet(str(tmp_path / "panel")).where("year = 2020")
    assert back.count() == 3
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_cut_lineage_uses_the_shared_folder(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.sum("x")).collect()[0][0] == 20


def test_bad_lines_are_set_aside(spark, tmp_path):
    lines = ["Date,Revenue,COGS", "2020-01-05,10.5,7", "05/01/2020,10.5,7", "2020-02-30,1,1", "2020-03-01,abc,1", "2020-03-02,1", "2020-03-03,,3", ",1,1"]
    (tmp_path / "sales.csv").write_text("\n".join(lines) + "\n")
    good, bad = scan_csv(spark, str(tmp_path / "sales.csv"), "sales")
    assert sorted(map(str, good.collect())) == sorted(map(str, list(spark.createDataFrame([(date(2020, 1, 5), 10.5, 7.0), (date(2020, 3, 3), None, 3.0), (None, 1.0, 1.0)], "Date DATE, Revenue DOUBLE, COGS DOUBLE").collect())))
    assert sorted(r["line"] for r in bad.collect()) == sorted(lines[2:6])


def rows(df):
    return sorted(map(tuple, df.collect()))


def two_files(spark, folder):
    events = read_parquet(spark, SMALL, "events")
    events.where("ts < '2024-01-15'").coalesce(1).write.parquet(f"{folder}/a")
    events.where("ts >= '2024-01-15'").coalesce(1).write.parquet(f"{folder}/b")
    return lambda: ru.event_stream(spark, f"{folder}/*", "*.parquet", files_per_batch=1)


def test_stream_equals_batch_and_append_closes_days(spark, tmp_path):
    batch = rows(ru.daily_rollup(read_parquet(spark, SMALL, "events")))
    assert rows(ru.rollup_log(ru.event_stream(spark, SMALL), str(tmp_path / "one"))) == batch
    # several files, one per micro-batch: the log still counts every event
    source = two_files(spark, tmp_path / "in")
    assert rows(ru.rollup_log(source(), str(tmp_path / "two"))) == batch
    # append mode emits a day once the watermark has passed it
    closed = ru.run_available(ru.daily_rollup(source(), "2 days"), str(tmp_path / "out"), str(tmp_path / "ckpt")).collect()
    assert closed and set(map(tuple, closed)) <= set(batch)
    assert max(r["day"] for r in closed) < date(2024, 1, 29)


def test_late_events_of_closed_days_are_dropped(spark, tmp_path):
    source = two_files(spark, tmp_path / "in")
    late = spark.sql("SELECT 9000001L AS event_id, TIMESTAMP_NTZ '2024-01-02 10:00:00' AS ts, 1L AS user_id, 'late' AS event_type, 5.0D AS value, '{}' AS props")
    spark.createDataFrame(late.collect(), read_parquet(spark, SMALL, "events").schema).coalesce(1).write.parquet(str(tmp_path / "in/c"))
    late.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-03 10:00:00'")).coalesce(1).write.parquet(str(tmp_path / "in/d"))
    log = ru.rollup_log(source(), str(tmp_path / "log"))
    assert log.where("event_type = 'late'").count() == 0
    assert rows(log) == rows(ru.daily_rollup(read_parquet(spark, SMALL, "events")))


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """The last batch runs again because its commit was lost."""
    source, folder = two_files(spark, tmp_path / "in"), tmp_path / "log"
    first = rows(ru.warning_log(source(), str(folder)))
    days = rows(ru.logged(spark, str(folder), "days", ru.daily_rollup(source()).schema, ru.DAY))
    files = sorted(f.name for f in (folder / "days").iterdir())
    commits = sorted((f for f in (folder / "progress/commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert rows(ru.warning_log(source(), str(folder))) == first
    assert rows(ru.logged(spark, str(folder), "days", ru.daily_rollup(source()).schema, ru.DAY)) == days
    assert sorted(f.name for f in (folder / "days").iterdir()) == files


def test_warnings_refer_to_days_that_have_arrived(spark, tmp_path):
    events = read_parquet(spark, SMALL, "events")
    rolled = ru.daily_rollup(events)
    want = rows(ru.day_change(rolled, rolled))
    assert rows(ru.warning_log(two_files(spark, tmp_path / "in")(), str(tmp_path / "log"))) == want and want


def test_rollup_days_do_not_depend_on_session_zone(spark):
    events = read_parquet(spark, SMALL, "events")
    utc = sorted(map(tuple, ru.daily_rollup(events).collect()))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        assert sorted(map(tuple, ru.daily_rollup(events).collect())) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tails_match_published_tables():
    assert abs(normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(student_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(student_two_sided(12.7062, 1) - 0.05) < 1e-6
    assert abs(chi_square_upper(18.307038, 10) - 0.05) < 1e-7
    assert abs(chi_square_upper(3.841459, 1) - 0.05) < 1e-7
    assert abs(chi_square_upper(2.0, 10) - 0.9963401531726563) < 1e-12
