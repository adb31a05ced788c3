"""Truncation of timestamps. Buckets of a duration count from the start of year 1, so those of 7 days begin on Mondays."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORIGIN = 62_135_596_800 * 1_000_000  # microseconds from year 1 to 1970


@dataclass
class Resampler:
    """The first that is set counts: by_year, by_month, by_day, by_week (from ``start_of_week``, 0 Sunday), by_duration."""

    by_year: bool = False
    by_month: bool = False
    by_day: bool = False
    by_week: bool = False
    start_of_week: int = 0
    by_duration: timedelta | None = None
    time_zone: str | None = None


def resampled(c: Column, kind: T.DataType, how: Resampler) -> Column:
    """``c`` truncated, in its own type: a date stays a date, a timestamp without zone stays one."""
    t = c.cast("timestamp_ntz")
    if how.time_zone:
        t = F.convert_timezone(F.lit("UTC"), F.lit(how.time_zone), t)
    if how.by_year or how.by_month or how.by_day:
        t = F.date_trunc("year" if how.by_year else "month" if how.by_month else "day", t)
    elif how.by_week:
        day = t.cast("date")
        t = F.date_sub(day, F.pmod(F.dayofweek(day) - F.lit(1 + how.start_of_week), F.lit(7)))
    elif how.by_duration:
        step = how.by_duration // timedelta(microseconds=1)
        at = F.unix_micros(t.cast("timestamp")) + F.lit(_ORIGIN)
        t = F.timestamp_micros(at - F.pmod(at, F.lit(step)) - F.lit(_ORIGIN))
    return t.cast(kind if isinstance(kind, (T.DateType, T.TimestampType)) else "timestamp_ntz")
