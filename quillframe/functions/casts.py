"""Casts between the working types. Every function is a pure expression: what can't be cast is null, and no other row changes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.config import DEFAULT, Options

STRING, FLOAT, DATETIME, TIME, DATE = "string", "float", "datetime", "time", "date"
#: A number as a whole text: no spaces around it, no type suffix, as Spark's own cast would let pass.
_NUMBER = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[iI]nf(?:inity)?|[nN]a[nN])$"


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def to_text(c: Column, kind: T.DataType) -> Column:
    """Text of a value: whole doubles without a fraction, timestamps as RFC 3339."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return c.cast("string")


def to_float(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        v = F.when(c.rlike(_NUMBER), c.try_cast("double"))
        return F.when(~F.isnan(v), v)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def _parsed(c: Column, pattern: str) -> Column:
    """Null where the text doesn't have the pattern; a year of two digits is one of 1969 to 2068."""
    t = F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(F.year(t) > 2068, t - F.make_ym_interval(F.lit(100))).otherwise(t) if re.search("(?<!y)yy(?!y)", pattern) else t


def to_time(c: Column, kind: T.DataType, options: Options = DEFAULT) -> Column:
    """Timestamps stay as they are; a text takes the first format it has, a clock time alone falls on 1970-01-01."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return F.coalesce(*(_parsed(c, f) for f in options.time_formats))
    return F.lit(None).cast("timestamp_ntz")


def cast(c: Column, kind: T.DataType, to: str, options: Options = DEFAULT) -> Column:
    if to == STRING:
        return to_text(c, kind)
    if to == FLOAT:
        return to_float(c, kind)
    if to == DATETIME:
        return to_time(c, kind, options)
    if to == DATE:
        return to_time(c, kind, options).cast("date")
    if to == TIME:
        return F.date_format(to_time(c, kind, options), "HH:mm:ss")
    raise ValueError(f"unknown type {to!r}; one of {STRING}, {FLOAT}, {DATETIME}, {TIME}, {DATE}")


def normalised(c: Column, kind: T.DataType, options: Options = DEFAULT) -> Column:
    """Null for NaN, for the options' sentinel texts, and for empty arrays and maps."""
    if isinstance(kind, T.DoubleType) and options.nan_is_null:
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.StringType):
        return F.when(~c.isin(options.nulls()), c) if options.nulls() else c
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, T.BinaryType):
        return F.when(F.length(c) > 0, c)
    return c


#: Texts by Python's patterns, and what they are; the fraction and the zone's name are cut off before.
_PATTERNS = (
    ("%Y-%m-%d", DATE),
    ("%m-%d-%Y", DATE),
    ("%Y/%m/%d", DATE),
    ("%m/%d/%Y", DATE),
    ("%m/%d/%y", DATE),
    ("%I:%M%p", TIME),
    ("%H:%M:%S", TIME),
    ("%Y-%m-%d %H:%M:%S %z", DATETIME),
    ("%Y-%m-%d %H:%M:%S", DATETIME),
    ("%Y-%m-%dT%H:%M:%S%z", DATETIME),
    ("%Y-%m-%dT%H:%M:%S", DATETIME),
    ("%d %b %y %H:%M", DATETIME),
)


def infer(values: list[str]) -> str:
    """Majority of the types of up to ten texts; on a tie the first of float, date, time, datetime, string."""
    from datetime import datetime

    def one(x: str) -> str:
        if re.match(_NUMBER, x):
            return FLOAT
        plain = re.sub(r"(?<=:\d\d)\.\d{1,9}(?=Z|[+-]\d\d:)|(?<=\d) [A-Z]{3,4}$", "", x)
        for pattern, kind in _PATTERNS:
            try:
                datetime.strptime(plain.upper() if kind == TIME else plain, pattern)
                return kind
            except ValueError:
                continue
        return STRING

    found = [one(x) for x in values[:10]]
    order = [FLOAT, DATE, TIME, DATETIME, STRING]
    return max(order, key=lambda k: (found.count(k), -order.index(k))) if found else STRING
