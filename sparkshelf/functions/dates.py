"""Dates and times. Timestamps are UTC; the business day is that of a fixed-offset zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kuala_Lumpur"
QUOTA_ZONE = "America/Los_Angeles"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc(c: str | Column) -> Column:
    """A time without zone as UTC (the session's zone is UTC)."""
    return _c(c).cast("timestamp")


def local_time(c: str | Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(utc(c), zone)


def local_day(c: str | Column, zone: str = ZONE) -> Column:
    return F.to_date(local_time(c, zone))


def local_day_bounds(day: str | Column, zone: str = ZONE) -> tuple[Column, Column]:
    """The half-open UTC span of a local day; days of 23 or 25 hours come out right."""
    day = _c(day)
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def quota_day_start(now: str | Column, zone: str = QUOTA_ZONE) -> Column:
    """When the quota day that holds now began."""
    return F.to_utc_timestamp(local_day(now, zone).cast("timestamp"), zone)


def parse_iso(c: str | Column) -> Column:
    """ISO-8601 text with Z or an offset; null if it is not."""
    return F.try_to_timestamp(F.regexp_replace(_c(c), "Z$", "+00:00"))


def utc_date(c: str | Column) -> Column:
    return F.to_date(utc(c))


def day_spine(first: Column, last: Column) -> Column:
    """All days from first to last, as an array to explode."""
    return F.sequence(first, last)


def elapsed_ms(a: str | Column, b: str | Column) -> Column:
    return F.unix_millis(utc(b)) - F.unix_millis(utc(a))


def eta(created: str | Column, n: str | Column, seconds_each: float, extra: int = 5) -> Column:
    """When a job of n items should be done."""
    return F.timestamp_micros(F.unix_micros(utc(created)) + ((_c(n) * seconds_each + extra) * 1_000_000).cast("long"))


def within(a: str | Column, b: str | Column, hours: float) -> Column:
    return F.abs(F.unix_micros(utc(a)) - F.unix_micros(utc(b))) <= int(hours * 3_600_000_000)
