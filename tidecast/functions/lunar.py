"""Lunar new year from the motions of moon and sun, for any year of ``YEARS``.

Months begin on the local day of the new moon. The month that holds the winter solstice is the eleventh. When thirteen months begin between two of these, the first one without a
principal term (a multiple of 30° of solar longitude) repeats the number of the month before it. The first month begins the year.

Times come from the usual truncated series; they are right to a few minutes, so a date could only be wrong where a new moon falls within minutes of midnight.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache
from math import floor, radians, sin

from pyspark.sql import Column, functions as F

YEARS = range(1900, 2200)
HOURS_EAST = 7
SYNODIC = 29.530588861
EPOCH = 2451550.09766                     # new moon of 6 January 2000, as a Julian day of dynamical time
CLOCK = 65 / 86400                        # dynamical time is ahead of the clock
UNIX_DAY = 2440588                        # Julian day that begins at noon of 1970-01-01


def new_moon(k: int) -> float:
    """Julian day of the k-th new moon after the epoch."""
    t = k / 1236.85
    sun = radians(2.5534 + 29.1053567 * k - 0.0000014 * t * t)
    moon = radians(201.5643 + 385.81693528 * k + 0.0107582 * t * t)
    node = radians(160.7108 + 390.67050284 * k - 0.0016118 * t * t)
    rising = radians(124.7746 - 1.56375588 * k)
    e = 1 - 0.002516 * t
    shift = (-0.4072 * sin(moon) + 0.17241 * e * sin(sun) + 0.01608 * sin(2 * moon) + 0.01039 * sin(2 * node) + 0.00739 * e * sin(moon - sun)
             - 0.00514 * e * sin(moon + sun) + 0.00208 * e * e * sin(2 * sun) - 0.00111 * sin(moon - 2 * node) - 0.00057 * sin(moon + 2 * node)
             + 0.00056 * e * sin(2 * moon + sun) - 0.00042 * sin(3 * moon) + 0.00042 * e * sin(sun + 2 * node) + 0.00038 * e * sin(sun - 2 * node)
             - 0.00024 * e * sin(2 * moon - sun) - 0.00017 * sin(rising))
    return EPOCH + SYNODIC * k + 0.00015437 * t * t + shift - CLOCK


def new_moon_day(k: int, hours_east: float) -> int:
    """Local day of the k-th new moon, in days since 1970-01-01."""
    return floor(new_moon(k) + 0.5 + hours_east / 24) - UNIX_DAY


def solar_term(day: int, hours_east: float) -> int:
    """Which of the twelve 30° arcs the sun is in when the local day begins; the winter solstice opens the tenth (9)."""
    t = (day + UNIX_DAY - 0.5 - hours_east / 24 + CLOCK - 2451545.0) / 36525
    m = radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t)
    centre = (1.914602 - 0.004817 * t) * sin(m) + 0.019993 * sin(2 * m) + 0.000289 * sin(3 * m)
    apparent = 280.46646 + 36000.76983 * t + 0.0003032 * t * t + centre - 0.00569 - 0.00478 * sin(radians(125.04 - 1934.136 * t))
    return floor(apparent % 360 / 30)


def eleventh_month(year: int, hours_east: float) -> int:
    """Number of the new moon that begins the month with the winter solstice of ``year``."""
    last = (date(year, 12, 31) - date(1970, 1, 1)).days
    k = floor((last + UNIX_DAY - EPOCH) / SYNODIC) + 1
    while new_moon_day(k, hours_east) > last or solar_term(new_moon_day(k, hours_east), hours_east) > 8:
        k -= 1
    return k


@cache
def lunar_new_year(year: int, hours_east: float = HOURS_EAST) -> date:
    first, following = eleventh_month(year - 1, hours_east), eleventh_month(year, hours_east)
    term = [solar_term(new_moon_day(first + i, hours_east), hours_east) for i in range(4)]
    repeated = following - first == 13 and (term[1] == term[2] or term[2] == term[3])
    return date(1970, 1, 1) + timedelta(days=new_moon_day(first + 2 + repeated, hours_east))


def near_lunar_new_year(ds: Column, before: int, after: int, hours_east: float = HOURS_EAST) -> Column:
    """From ``before`` days ahead of the new year of the day's own year to ``after`` days behind it. An error for years outside ``YEARS``."""
    days = F.lit([(lunar_new_year(y, hours_east) - date(1970, 1, 1)).days for y in YEARS])
    outside = F.raise_error(F.concat(F.lit("no lunar calendar for "), F.year(ds).cast("string")))
    new_year = F.when(F.year(ds).between(YEARS[0], YEARS[-1]), F.get(days, F.year(ds) - YEARS[0])).otherwise(outside.cast("int"))
    return (F.unix_date(ds) - new_year).between(-before, after)
