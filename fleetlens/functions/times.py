"""Instants, elapsed time and durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .columns import as_col

Instant = Column | str | dt.datetime


def instant(value: Instant) -> Column:
    """An ``as_of`` argument (text, datetime or column) as a UTC timestamp."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def instant_like(df: DataFrame, col: str, value: Instant) -> Column:
    """An instant in the type of a column, so that comparing the two can be pushed into the scan."""
    return instant(value).cast(df.schema[col].dataType)


def span(secs: float) -> Column:
    """A number of seconds as an interval."""
    return F.make_dt_interval(secs=F.lit(secs))


def seconds(col: Column | str) -> Column:
    """Whole seconds since the epoch; also takes timestamps without a zone."""
    return F.unix_seconds(as_col(col).cast("timestamp"))


def micros(col: Column | str) -> Column:
    return F.unix_micros(as_col(col).cast("timestamp"))


def elapsed(start: Column | str, end: Column | str, unit: str = "second") -> Column:
    """Second or minute boundaries crossed, or exact seconds as a double."""
    if unit == "second":
        return seconds(end) - seconds(start)
    if unit == "minute":
        return (F.floor(seconds(end) / 60) - F.floor(seconds(start) / 60)).cast("long")
    if unit == "exact":
        return (micros(end) - micros(start)) / F.lit(1e6)
    raise ValueError("unit is 'second', 'minute' or 'exact'")


def seconds_since(start: Column | str, as_of: Instant) -> Column:
    """Exact seconds from ``start`` to ``as_of`` as a double."""
    return (F.unix_micros(instant(as_of)) - micros(start)) / F.lit(1e6)


def format_duration(secs: Column | str) -> Column:
    """``1h 2m 3s``; ``N/A`` when NULL or not positive."""
    s = as_col(secs).cast("long")
    hours = F.floor(s / 3600).cast("string")
    minutes = F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    rest = F.pmod(s, F.lit(60)).cast("string")
    text = F.concat(hours, F.lit("h "), minutes, F.lit("m "), rest, F.lit("s"))
    return F.when(s > 0, text).otherwise(F.lit("N/A"))


def whole_days(secs: Column | str) -> Column:
    return F.floor(as_col(secs) / 86400).cast("long")


def whole_hours(secs: Column | str) -> Column:
    return F.floor(as_col(secs) / 3600).cast("long")


def parse_when(col: Column | str, kind: str) -> Column:
    """Timestamp from epoch seconds or micros, ISO text, or a stamp inside a name."""
    value = as_col(col)
    if kind == "epoch":
        return F.timestamp_seconds(value)
    if kind == "epoch_us":
        return F.timestamp_micros(value.cast("long"))
    if kind == "iso":
        return F.try_to_timestamp(value)
    if kind == "name":
        stamp = F.regexp_extract(value, r"(\d{8}_\d{6})", 1)
        return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
    raise ValueError("kind is 'epoch', 'epoch_us', 'iso' or 'name'")


def epoch_or_never(col: Column | str) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss``; ``Never`` for 0."""
    value = as_col(col)
    text = F.date_format(F.timestamp_seconds(value), "yyyy-MM-dd HH:mm:ss")
    return F.when(value > 0, text).otherwise(F.lit("Never"))


def stamp(as_of: Instant) -> Column:
    """Name stamp ``yyyyMMdd_HHmmss`` of an instant."""
    return F.date_format(instant(as_of), "yyyyMMdd_HHmmss")
