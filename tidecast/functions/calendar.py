"""Calendar facts of a date column. Everything here is a narrow projection: no table, no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidecast.fixed_values import EVENTS, PROMO_EVERY_YEAR, PROMO_ODD_YEARS
from tidecast.functions.lunar import near_lunar_new_year


def day_number(ds: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(ds)


def month_start(ds: Column) -> Column:
    return F.trunc(ds, "MM")


def month_key(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def parity(ds: Column) -> Column:
    return F.pmod(F.year(ds), F.lit(2))


def is_month_end(ds: Column) -> Column:
    return (F.last_day(ds) == ds).cast("int")


def days_to_month_end(ds: Column) -> Column:
    return F.datediff(F.last_day(ds), ds)


def week_of_month(ds: Column) -> Column:
    return (F.floor((F.dayofmonth(ds) - 1) / 7) + 1).cast("int")


def is_even_year(ds: Column) -> Column:
    return (parity(ds) == 0).cast("int")


def urban_expected(ds: Column) -> Column:
    """July and August of odd years."""
    return (F.month(ds).isin(7, 8) & (parity(ds) == 1)).cast("int")


def days_to_promo(ds: Column, cap: int = 60) -> Column:
    """Distance in days of year to the nearest annual promotion start, either side, capped."""
    doy = F.dayofyear(ds)
    gaps = [F.abs(doy - start) for start, _ in PROMO_EVERY_YEAR.values()]
    return F.least(*gaps, F.lit(cap)).cast("int")


CALENDAR_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "dayofyear": F.dayofyear,
    "dayofweek": F.weekday,
    "weekofyear": F.weekofyear,
    "days_in_month": lambda ds: F.dayofmonth(F.last_day(ds)),
    "is_month_end": is_month_end,
    "days_to_month_end": days_to_month_end,
    "week_of_month": week_of_month,
    "is_even_year": is_even_year,
    "urban_expected": urban_expected,
    "days_to_promo": days_to_promo,
}


def calendar_columns(ds: Column, names) -> list[Column]:
    return [CALENDAR_PARTS[name](ds).alias(name) for name in names]


def quarter_label(ds: Column) -> Column:
    return F.concat(F.year(ds).cast("string"), F.lit("Q"), F.quarter(ds).cast("string"))


def month_label(ds: Column) -> Column:
    return F.date_format(ds, "yyyy-MM")


def _in_run(ds: Column, year: Column, start: int, days: int, odd_only: bool, first_year: int) -> Column:
    began = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), start - 1)
    held = F.datediff(ds, began).between(0, days - 1) & (year >= first_year)
    return held & (F.pmod(year, F.lit(2)) == 1) if odd_only else held


def in_promo(ds: Column, family: str, first_year: int = 0) -> Column:
    """Is the day inside a run of the family? A run may start late in the previous year and wrap into January."""
    odd_only = family in PROMO_ODD_YEARS
    start, days = PROMO_ODD_YEARS[family] if odd_only else PROMO_EVERY_YEAR[family]
    this_year = _in_run(ds, F.year(ds), start, days, odd_only, first_year)
    if start + days - 1 <= 365:
        return this_year
    return this_year | _in_run(ds, F.year(ds) - 1, start, days, odd_only, first_year)


def promo_flag_by_day_of_year(ds: Column) -> Column:
    """0/1 promotion flag from day-of-year ranges only, so runs stop at 31 December."""
    doy = F.dayofyear(ds)
    every = [(doy >= s) & (doy < s + n) for s, n in PROMO_EVERY_YEAR.values()]
    odd = [(doy >= s) & (doy < s + n) & (parity(ds) == 1) for s, n in PROMO_ODD_YEARS.values()]
    hit = every[0]
    for cond in every[1:] + odd:
        hit = hit | cond
    return hit.cast("int")


def event_flag(ds: Column, event: str, first_year: int = 0, last_year: int | None = None) -> Column:
    """Boolean membership of a day in one of the nine events.

    ``last_year`` is the final calendar year covered; its December has no month-end event.
    """
    if event == "end_of_month":
        flag = days_to_month_end(ds) < 4
        if last_year is not None:
            flag = flag & ~((F.year(ds) == last_year) & (F.month(ds) == 12))
        return flag
    if event == "start_of_month":
        return F.dayofmonth(ds) <= 3
    if event == "tet":
        return near_lunar_new_year(ds, 2, 7)
    return in_promo(ds, event, first_year)


def event_columns(ds: Column, events=EVENTS, first_year: int = 0, last_year: int | None = None) -> list[Column]:
    return [event_flag(ds, e, first_year, last_year).cast("int").alias(e) for e in events]
