"""Timestamps of log lines. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})?$"


def _part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, _RFC3339, n)


def _instant(c: Column) -> Column:
    zone = F.when(_part(c, 3) == "", "Z").otherwise(_part(c, 3))
    return F.when(c.rlike(_RFC3339), F.try_to_timestamp(F.concat(_part(c, 1), zone)))


def _since_epoch(c: Column, digits: int) -> Column:
    """Whole units of 10^-digits seconds; a longer fraction is cut."""
    fraction = F.rpad(F.substring(_part(c, 2), 1, digits), digits, "0").try_cast("long")
    return F.unix_seconds(_instant(c)) * 10**digits + F.coalesce(fraction, F.lit(0))


def rfc3339_nanos(c: Column) -> Column:
    """Nanoseconds since 1970 (long). A fraction of any length is cut to nine digits; no zone is UTC; what isn't a time is null."""
    return _since_epoch(c, 9)


def rfc3339_ts(c: Column) -> Column:
    """The same as a timestamp, cut to microseconds."""
    return F.timestamp_micros(_since_epoch(c, 6))


def epoch_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def epoch_seconds(c: Column) -> Column:
    return epoch_micros(c) / 1e6


def format_time(c: Column) -> Column:
    """`2024-01-31 23:59:59Z`; null is Never."""
    return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss'Z'"), F.lit("Never"))


def leading_time(c: Column) -> tuple[Column, Column]:
    """The time before the first space (null if it isn't one) and the rest of the line; without a space the time is null."""
    has = F.instr(c, " ") > 0
    return F.when(has, rfc3339_ts(F.substring_index(c, " ", 1))), F.when(has, F.regexp_replace(c, r"(?s)^[^ ]* ", "")).otherwise(c)
