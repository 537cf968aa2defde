"""Time helpers. All of them assume a session in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: time buckets are counted from Monday 2000-01-03 00:00 UTC.
BUCKET_ORIGIN_SECONDS = 946_857_600

MICROS = 1_000_000


def event_time(epoch: Column, unit: str = "s") -> Column:
    """Event time from an epoch column in seconds ("s") or milliseconds ("ms")."""
    if unit == "s":
        return F.timestamp_seconds(epoch)
    if unit == "ms":
        return F.timestamp_millis(epoch)
    raise ValueError(f"unknown epoch unit {unit!r}")


def partition_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def bucket_number(ts: Column, seconds: int) -> Column:
    """Ordinal of the fixed-width time bucket a timestamp falls into."""
    shifted = F.unix_micros(ts) - F.lit(BUCKET_ORIGIN_SECONDS * MICROS)
    return F.floor(shifted / F.lit(seconds * MICROS))


def bucket_start(ts: Column, seconds: int) -> Column:
    start = bucket_number(ts, seconds) * F.lit(seconds * MICROS)
    return F.timestamp_micros((start + F.lit(BUCKET_ORIGIN_SECONDS * MICROS)).cast("long"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week_sunday0(ts: Column) -> Column:
    return F.dayofweek(ts) - F.lit(1)


def day_of_week_monday0(ts: Column) -> Column:
    return F.weekday(ts)


def cycle(position: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.lit(2 * math.pi) * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def minute_boundaries(first: Column, last: Column) -> Column:
    """How many minute marks lie between two timestamps."""
    def minute(ts: Column) -> Column:
        return F.unix_timestamp(F.date_trunc("minute", ts))
    return (minute(last) - minute(first)) / F.lit(60)


def near(a: Column, b: Column, seconds: int) -> Column:
    """|a - b| <= seconds in whole microseconds, without calendar arithmetic."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) <= F.lit(seconds * MICROS)


def within(a: Column, b: Column, seconds: int) -> Column:
    """|a - b| <= seconds, in the form the stream planner derives state bounds from.

    An interval is added to a calendar time row by row, which costs far more than ``near``.
    """
    span = F.expr(f"INTERVAL '{seconds}' SECOND")
    return (a >= b - span) & (a <= b + span)
