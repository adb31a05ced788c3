"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillframe.functions.resample import Resampler
from quillframe.operators.frame import Frame
from quillframe.streaming.tumbling import first_by_key, tumbling


@pytest.fixture
def source(spark, tmp_path):
    d = datetime(2020, 1, 1)
    rows = [(i, d + timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)] + [(99, d + timedelta(days=30), "z", 0.0)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz, k string, v double").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    return df, f"{tmp_path}/in"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@pytest.mark.parametrize("every", [timedelta(minutes=30), timedelta(days=7)])
def test_tumbling_equals_batch(spark, source, every):
    df, path = source
    stream = spark.readStream.schema(df.schema).parquet(path)
    name = f"out_{every.days}_{every.seconds}"
    got = run(spark, tumbling(stream, "ts", every, timedelta(hours=1), ["k"], {"v": F.sum("v")}), name)
    f = Frame.from_spark(df, ["i"], ["i"]).resample({"ts": Resampler(by_duration=every)})
    want = f.group_by("k", "ts").sum("v").to_spark().filter("k <> 'z'")  # the last bucket is still open
    rows = lambda x, v: sorted((r.k, r.ts, r[v]) for r in x.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect())
    assert rows(got, "v") == rows(want, "sum_v")


def test_first_by_key(spark, source):
    df, path = source
    got = run(spark, first_by_key(spark.readStream.schema(df.schema).parquet(path), "ts", timedelta(days=60), ["k"]), "firsts")
    assert sorted(r.k for r in got.collect()) == ["a", "b", "z"]
