"""Values and names of metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that the metric line format keeps for itself.
RESERVED_NAMES = ("logfile", "monitor", "metric", "value", "instance", "severity")


def typed_value(c: Column) -> Column:
    """struct(value double, value_str string): a number (with a point: a fraction, else whole) or the text."""
    number = F.when(c.contains("."), c.try_cast("double")).otherwise(c.try_cast("long").cast("double"))
    return F.struct(number.alias("value"), F.when(number.isNull(), c).alias("value_str"))


def _unit(c: Column, units: dict[str, float]) -> Column:
    parts = F.split(F.trim(F.lower(c)), r"\s+")
    factor = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(v))])[F.get(parts, F.lit(1))]
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") * factor)


def to_megabytes(c: Column) -> Column:
    """`6.38 MB`, kb, gb or tb in decimal megabytes; else null."""
    return _unit(c, {"kb": 0.001, "mb": 1.0, "gb": 1000.0, "tb": 1_000_000.0})


def to_milliseconds(c: Column) -> Column:
    """`749 ms` or `0.9 s` in milliseconds; else null."""
    return _unit(c, {"ms": 1.0, "s": 1000.0})


def to_bool(c: Column) -> Column:
    """A text: false if it is empty, f, or false in any case, else true. Null is false."""
    return F.coalesce(~F.lower(c).isin("false") & ~c.isin("", "f"), F.lit(False))


def number_to_bool(c: Column) -> Column:
    """0 and 1; another number is an error."""
    return F.when(c.isNull() | (c == 0), F.lit(False)).when(c == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a boolean is 0 or 1")).cast("boolean"))


def valid_metric_name(c: Column) -> Column:
    """A name of letters, digits, _ . and - that begins with a letter or _; reserved names get a final _."""
    clean = F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_")
    named = F.when(clean.rlike(r"^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("sa_"), clean))
    return F.when(named.isin(*RESERVED_NAMES), F.concat(named, F.lit("_"))).otherwise(named)
