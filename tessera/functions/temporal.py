"""Dates, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date(ts: Column) -> Column:
    return F.to_date(ts)


def days(n: int | Column) -> Column:
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


weeks = lambda n: days(7 * n)
hours = lambda n: F.make_dt_interval(hours=F.lit(n))
minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
seconds = lambda n: F.make_dt_interval(secs=F.lit(n))
milliseconds = lambda n: F.make_dt_interval(secs=F.lit(n) / 1000)
microseconds = lambda n: F.make_dt_interval(secs=F.lit(n) / 1_000_000)
months = lambda n: F.make_ym_interval(months=F.lit(n))
years = lambda n: F.make_ym_interval(years=F.lit(n))


def date_plus(d: Column, interval: Column) -> Column:
    """A date and an interval make a timestamp."""
    return d.cast("timestamp_ntz") + interval


def date_minus_date(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def at_time_zone(ts: Column, zone: str) -> Column:
    """A timestamp without a zone, read in that zone, in UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def now() -> Column:
    """The time at which the query began, without a zone: one value for all rows."""
    return F.current_timestamp().cast("timestamp_ntz")


def today() -> Column:
    return F.current_date()


def intervals_added(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b, or a - b, of two intervals of days and times or of two of years and months."""
    return a + b if sign > 0 else a - b


def time_plus(time: Column, interval: Column) -> Column:
    """A time of day, as text HH:MM:SS, and an interval of days and times: it goes round at midnight."""
    return F.date_format(F.concat(F.lit("1970-01-01 "), time).cast("timestamp_ntz") + interval, "HH:mm:ss")


def time_of(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
