"""Date and time functions, each from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST = "2012-10-29"
DAY = 86_400_000_000


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def days_between(start: Column, stop: Column) -> Column:
    """All days from start to stop, both inclusive; none if start is after stop."""
    return F.when(start <= stop, F.sequence(start, F.greatest(start, stop), F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def months_between(start: Column, stop: Column) -> Column:
    """The first days of months from start (rounded up) to stop."""
    first = F.when(F.day(start) == 1, start).otherwise(next_month(start))
    return F.when(first <= stop, F.sequence(first, F.greatest(first, stop), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def parse_iso(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_plain(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss")


def ordinal(day: Column) -> Column:
    """Days since the year 1, whose first day is 1."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1


def micros(start: Column, stop: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, stop)


def days_floor(start: Column, stop: Column) -> Column:
    return F.floor(micros(start, stop) / DAY).cast("bigint")


def days_ceil(start: Column, stop: Column) -> Column:
    return F.ceil(micros(start, stop) / DAY).cast("bigint")


def compact(day: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.date_format(day, pattern)


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))
