"""Resample and group, over a stream: buckets of a duration close when the watermark has passed them.

Buckets count from the start of year 1, as those of ``Resampler(by_duration=...)`` do, so a closed stream gives what the batch query gives.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORIGIN_US = 62_135_596_800 * 1_000_000


def tumbling(stream: DataFrame, time: str, every: timedelta, late: timedelta, keys: list[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """``aggregates`` of each bucket and key: keys, ``time`` (the bucket's start) and the aggregates. Rows later than ``late`` are dropped.

    Partial aggregates are combined before the shuffle; state is held for open buckets only.
    """
    step = every // timedelta(microseconds=1)
    # window() counts from 1970: what year 1 is off by
    start = f"{(-_ORIGIN_US) % step} microseconds"
    df = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{late // timedelta(microseconds=1)} microseconds")
    bucket = F.window(time, f"{step} microseconds", None, start)
    out = df.groupBy(bucket.alias("__bucket"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(*keys, F.col("__bucket.start").alias(time), *aggregates)


def first_by_key(stream: DataFrame, time: str, late: timedelta, keys: list[str]) -> DataFrame:
    """The first arrival of each key within the watermark: ``unique`` of a stream, with state that expires."""
    df = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{late // timedelta(microseconds=1)} microseconds")
    return df.dropDuplicatesWithinWatermark(keys)
