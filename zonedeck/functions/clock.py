"""Dates as numbers: day counts from 1601, packed dates, milliseconds from 1900."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of the day count, and the milliseconds between 1900-01-01 and 1970-01-01.
DAY_ZERO = "1600-12-31"
MILLIS_1900 = 2208988800000


def integer_of_date(day: Column) -> Column:
    return F.datediff(day, F.to_date(F.lit(DAY_ZERO)))


def date_of_integer(number: Column) -> Column:
    return F.date_add(F.to_date(F.lit(DAY_ZERO)), number)


def yyyymmdd(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def yymmdd(day: Column) -> Column:
    return yyyymmdd(day) % 1000000


def date_of_yyyymmdd(number: Column) -> Column:
    """NULL where the number is no date."""
    return F.try_to_timestamp(F.lpad(number.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("date")


def abstime(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp")) + MILLIS_1900


def time_of_abstime(millis: Column) -> Column:
    return F.timestamp_millis(millis - MILLIS_1900)


def clock_text(ts: Column, separator: str = ":") -> Column:
    return F.date_format(ts, f"HH'{separator}'mm'{separator}'ss")


def current_date_text(now: Column) -> Column:
    """21 characters of date, time and zone; the clock is an argument so that runs repeat."""
    return F.concat(F.date_format(now, "yyyyMMddHHmmss"), F.lit("00+0000"))
