"""Helpers that the text operators share: tables, row keys, the shared folder and Arrow plumbing."""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


KEY = ("id", "no_id", "hash")
#: Rows that a broadcast of row keys has at most: some 10 MB.
FEW = 1 << 18


def name(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_key(*hashed: str) -> list[Column]:
    """The columns ``KEY``, which name a row: its id, whether that is null, and a hash of ``hashed`` (the text by default) and their nulls."""
    parts = [x for c in hashed or ("text",) for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    found = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(*parts))
    return [c.alias(k) for c, k in zip(found, KEY, strict=True)]


def with_key(df: DataFrame, *hashed: str) -> DataFrame:
    """``row``, a struct of all columns of ``df``, and the columns ``KEY``: no name of a caller's meets one of these."""
    return df.select(F.struct(*map(name, df.columns)).alias("row"), *row_key(*hashed))


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, once each: rows that share id and text are one row repeated.

    ``judged``: ``KEY`` and ``kept`` of every row. Where few keys are dropped or repeated, these go to every task and no row moves; else
    the rows are dealt by their keys.
    """
    spark = docs.sparkSession
    keys = judged.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept")
    keys = written(keys, f"{shared_dir(spark)}/odd")
    n = keys.agg(F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    rows = with_key(docs)
    if n[0] > FEW:
        gone = keys.filter("not kept").select(*KEY)
        return rows.join(gone, list(KEY), "left_anti").dropDuplicates(list(KEY)).select("row.*")
    once = rows.join(F.broadcast(keys.select(*KEY)), list(KEY), "left_anti").select("row.*")  # at most FEW rows
    if not n[1]:
        return once
    again = rows.join(F.broadcast(keys.filter("kept").select(*KEY)), list(KEY), "left_semi").dropDuplicates(list(KEY))
    return once.unionByName(again.select("row.*"))


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``shared_dir`` makes inside go at the end: for steps whose result is written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; it goes when the session's JVM ends.

    Where the setting is missing (tests), a temporary folder of this machine takes its place.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quill_dir", None)
    if not top:
        top = sc._quill_dir = f"file://{tempfile.mkdtemp(prefix='quillframe-')}"
    out = f"{top.rstrip('/')}/quill-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if _scratch:
        _scratch[-1].append(out)
    return str(fs.makeQualified(path))  # with its scheme: a bare path may mean one store to Spark and another to Python


def written(df: DataFrame, to: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither recompute it nor depend on one executor."""
    df.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def _fs(uri: str):
    """The file system and path of a shared file; plain paths and file: are local to a shared mount."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return None, at.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, parts: list) -> None:
    """Writes a shared file whole or not at all, so a retried or doubled task does no harm."""
    fs, path = _fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(part, path)
    else:
        with fs.open_output_stream(part) as f:
            for x in parts:
                f.write(x)
        fs.move(part, path)


def mapped(uri: str) -> np.ndarray:
    """A shared file's bytes as a read-only memory map. From a store that can't be mapped, a local copy is mapped and unlinked at once."""
    fs, path = _fs(uri)
    if fs is not None:
        fd, local = tempfile.mkstemp()
        with os.fdopen(fd, "wb") as to, fs.open_input_stream(path) as f:
            shutil.copyfileobj(f, to, 1 << 20)
        path = local
    try:
        with open(path, "rb") as f:  # the map holds no descriptor, so a worker can map thousands of files
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8) if os.path.getsize(path) else np.empty(0, np.uint8)
    finally:
        if fs is not None:
            os.unlink(path)


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once a session: they may have no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_quill_shipped", None):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="quillframe-"), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for x in sorted(top.rglob("*.py")):
            z.write(x, f"{top.name}/{x.relative_to(top)}")
    sc.addPyFile(to)
    sc._quill_shipped = to


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return map_batches(df, run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows, null as empty, without a copy where there's no null."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def texts(column: pa.Array) -> Iterator[str]:
    """The column's texts one at a time, null as empty."""
    for x in column:
        yield x.as_py() or ""


def chunks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes; a longer row has a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
