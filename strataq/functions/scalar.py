"""Scalar functions whose meaning differs from Spark's functions of the same name, as Column expressions.

Everything else (upper, lower, length, abs, sqrt, ceil, floor, round, ...) is used straight from pyspark.sql.functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["concat", "substring", "trim", "ltrim", "rtrim", "now_text", "current_date_text", "to_time", "date_part", "date_trunc", "add", "subtract", "multiply", "divide", "modulo", "length", "octets", "upper", "lower", "DATE_PARTS", "TRUNC_UNITS"]

#: fixed values: the accepted names of date parts and units
DATE_PARTS = ("year", "month", "day", "hour", "minute", "second", "dow", "dayofweek", "doy", "dayofyear", "quarter")
TRUNC_UNITS = ("year", "month", "day", "hour", "minute")
#: fixed values: the accepted spellings of times in text
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat(*columns) -> Column:
    """Joins its arguments and skips NULLs."""
    return F.concat_ws("", *[_col(c).cast("string") for c in columns])


def substring(s, start, length=None) -> Column:
    """From 1-based `start`; starts below 1 count as 1, and beyond the end there is the empty string."""
    start = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1))
    rest = F.length(_col(s)) if length is None else (length if isinstance(length, Column) else F.lit(length))
    return F.substring(_col(s), start, rest)


def trim(s) -> Column:
    """Strips all white space, not only blanks."""
    return F.regexp_replace(_col(s), r"(?U)^\s+|\s+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(_col(s), r"(?U)^\s+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(_col(s), r"(?U)\s+$", "")


def upper(s) -> Column:
    return F.upper(_col(s))


def lower(s) -> Column:
    return F.lower(_col(s))


def length(s) -> Column:
    """Characters; `octets` gives bytes."""
    return F.length(_col(s)).cast("bigint")


def octets(s) -> Column:
    return F.octet_length(_col(s)).cast("bigint")


def now_text() -> Column:
    return F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss")


def current_date_text() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def to_time(d) -> Column:
    """Dates and timestamps as they are, texts by the accepted layouts (NULL if none fits)."""
    text = _col(d).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS], F.try_to_timestamp(text))


def date_part(part: str, d, text: bool = False) -> Column:
    """A field of a date; day of week counts from Sunday as 0, seconds are whole."""
    d = to_time(d) if text else _col(d)
    fields = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "dow": lambda x: F.dayofweek(x) - 1, "dayofweek": lambda x: F.dayofweek(x) - 1, "doy": F.dayofyear, "dayofyear": F.dayofyear, "quarter": F.quarter,
    }
    if part.lower() not in fields:
        raise ValueError(f"unknown date part: {part}")
    return fields[part.lower()](d).cast("bigint")


def date_trunc(unit: str, d, text: bool = False) -> Column:
    """The start of the unit, without a time zone."""
    if unit.lower() not in TRUNC_UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return F.date_trunc(unit.lower(), to_time(d) if text else _col(d)).cast("timestamp_ntz")


def add(a, b) -> Column:
    return _col(a).cast("double") + _col(b).cast("double")


def subtract(a, b) -> Column:
    return _col(a).cast("double") - _col(b).cast("double")


def multiply(a, b) -> Column:
    return _col(a).cast("double") * _col(b).cast("double")


def divide(a, b) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def modulo(a, b) -> Column:
    """Of the truncated integers; NULL for a zero divisor."""
    return F.try_mod(_col(a).cast("bigint"), _col(b).cast("bigint"))
