"""Dates, windows and relative-time text. ``as_of`` is always passed in."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens.errors import AnalyticsError


def day(col) -> Column:
    return F.to_date(col)


def week_start(d: Column) -> Column:
    """Sunday on or before the date."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_end(d: Column) -> Column:
    """Saturday on or after the date."""
    return F.date_add(d, 7 - F.dayofweek(d))


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM")


def time_range(preset: str, as_of: datetime, start: datetime | None = None, end: datetime | None = None):
    """(start, end) of a dashboard preset. 24h is exact; 7d and 30d start at midnight."""
    if preset == "24h":
        return as_of - timedelta(hours=24), as_of
    if preset in ("7d", "30d", "90d"):
        first = as_of - timedelta(days=int(preset[:-1]))
        return first.replace(hour=0, minute=0, second=0, microsecond=0), as_of
    if preset == "custom":
        return start, end
    raise AnalyticsError(f"unknown time range {preset!r}")


def parse_timestamp(col: Column) -> Column:
    """First of the accepted log timestamp formats that parses, else null."""
    return F.coalesce(
        F.try_to_timestamp(col),
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")),
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def relative_time(ts: Column, as_of: Column) -> Column:
    hours = F.floor(seconds_between(ts, as_of) / 3600)
    return (
        F.when(hours < 1, F.lit("Less than 1h ago"))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def time_left(ends_at: Column, as_of: Column) -> Column:
    seconds = seconds_between(as_of, ends_at)
    days = F.floor(seconds / 86400).cast("string")
    hours = F.floor((seconds % 86400) / 3600)
    minutes = F.floor((seconds % 3600) / 60).cast("string")
    return (
        F.when(seconds <= 0, F.lit("Ended"))
        .when(seconds >= 86400, F.concat(days, F.lit("d "), hours.cast("string"), F.lit("h left")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes, F.lit("m left")))
        .otherwise(F.concat(minutes, F.lit("m left")))
    )


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms.isNull() | (ms == 0), F.lit("N/A"))
        .when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))
        .otherwise(F.concat(F.format_string("%.1f", ms / 60000.0), F.lit("m")))
    )
