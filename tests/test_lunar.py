"""Computed lunar new year against listed dates, both time zones, and as a column."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidecast.fixed_values import LUNAR_NEW_YEAR
from tidecast.functions.calendar import event_flag
from tidecast.functions.lunar import YEARS, lunar_new_year

OTHERS = ("1985-01-21", "2003-02-01", "2004-01-22", "2005-02-09", "2006-01-29", "2007-02-17", "2008-02-07", "2009-01-26", "2010-02-14", "2011-02-03",
          "2025-01-29", "2026-02-17", "2027-02-06", "2028-01-26", "2029-02-13", "2030-02-02", "2031-01-23", "2032-02-11", "2033-01-31", "2034-02-19")


def test_equal_to_listed_dates():
    for text in (*LUNAR_NEW_YEAR, *OTHERS):
        assert str(lunar_new_year(int(text[:4]))) == text


def test_an_hour_further_east():
    """Years in which the new moon falls between the two midnights, or the months are numbered differently."""
    assert [str(lunar_new_year(y, 8)) for y in (1985, 2007, 2030, 2034)] == ["1985-02-20", "2007-02-18", "2030-02-03", "2034-02-19"]


def test_every_year_is_in_its_season_and_months_are_whole():
    days = [lunar_new_year(y) for y in YEARS]
    assert all(date(d.year, 1, 20) <= d <= date(d.year, 2, 21) for d in days)
    assert {(b - a).days for a, b in zip(days, days[1:])} <= {353, 354, 355, 383, 384, 385}


def test_flag_of_a_day(spark):
    days = [date(y, 1, 1) + timedelta(days=k) for y in (2005, 2010, 2027) for k in range(365)]
    df = spark.createDataFrame([(d,) for d in days], "ds DATE")
    got = {r.ds for r in df.where(event_flag(F.col("ds"), "tet")).collect()}
    assert got == {lunar_new_year(y) + timedelta(days=k) for y in (2005, 2010, 2027) for k in range(-2, 8)}
    with pytest.raises(Exception, match="no lunar calendar for 1850"):
        spark.sql("SELECT DATE '1850-02-01' AS ds").where(event_flag(F.col("ds"), "tet")).collect()
