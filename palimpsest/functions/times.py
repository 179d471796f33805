"""Time functions; the session's time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, end_of_day: bool = False) -> Column:
    """A filter bound: blank is null, ten characters are a day (its start or last microsecond), else ISO-8601; naive is UTC."""
    raw = F.trim(value)
    day = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))
    day = F.timestamp_micros(F.unix_micros(day) + 86_399_999_999) if end_of_day else day
    return F.when(raw == "", None).when(F.length(raw) == 10, day).otherwise(raw.try_cast("timestamp"))


def ordered(low: Column, high: Column) -> Column:
    """Whether a range is not inverted; an open side always fits."""
    return F.coalesce(low <= high, F.lit(True))


def shown(ts: Column) -> Column:
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def or_line(ts: Column, line: Column) -> Column:
    """The time, or the epoch plus the line's number in microseconds: ordered and the same in every run."""
    return F.coalesce(ts, F.timestamp_micros(line))


def from_export(value: Column, line: Column) -> Column:
    """Epoch seconds or ISO-8601 text, else the line's time."""
    seconds = value.try_cast("double")
    return or_line(F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), value.try_cast("timestamp")), line)
