"""Sinks: records, CSV, JSON, dataclasses, parquet; comparison of a frame with what is expected; mock data."""

from __future__ import annotations

import csv
import dataclasses
import io
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import casts
from quillframe.operators.blocks import directed
from quillframe.operators.frame import Frame
from quillframe.operators.grouped import Grouped

NULL = "(null)"


def _heads(frame: Frame, fields) -> list[list[str]]:
    n = frame.num_col_levels()
    if n == 1:
        return [[f.name for f in fields]]
    split = [f.name.split(frame.options.separator) if f in frame.cols else [""] * (n - 1) + [f.name] for f in fields]
    return [[s[k] if k < len(s) else "" for s in split] for k in range(n)]


def _fields(frame: Frame, labels: bool):
    return [*(frame.labels if labels else ()), *frame.cols]


def to_records(frame: Frame, labels: bool = True, by_column: bool = False) -> list[list[str]]:
    """Headers and rows as texts, on the driver; null as ``(null)``."""
    fields = _fields(frame, labels)
    cols = [F.coalesce(casts.to_text(F.col(f.id), frame.kind(f)), F.lit(NULL)) for f in fields]
    rows = [*_heads(frame, fields), *(list(r) for r in frame._sdf.orderBy(*directed(frame.order)).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).collect())]
    return [list(r) for r in zip(*rows, strict=True)] if by_column else rows


def to_rows(frame: Frame, labels: bool = True, by_column: bool = False) -> list[list[Any]]:
    """Headers and rows as values; null as None."""
    fields = _fields(frame, labels)
    rows = [*_heads(frame, fields), *(list(r) for r in frame._sdf.orderBy(*directed(frame.order)).select(*(f.id for f in fields)).collect())]
    return [list(r) for r in zip(*rows, strict=True)] if by_column else rows


def write_csv(frame: Frame, path: str, labels: bool = True, separator: str = ",") -> None:
    """CSV files in the frame's order, written by the executors; each has the header."""
    fields = _fields(frame, labels)
    names = [f"{f.name}" for f in fields]
    if len(set(names)) < len(names):
        raise ValueError("CSV columns need different names: deduplicate_names() first")
    cols = [F.coalesce(casts.to_text(F.col(f.id), frame.kind(f)), F.lit(NULL)).alias(f.name) for f in fields]
    frame._sdf.orderBy(*directed(frame.order)).select(*cols).write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "").csv(path)


def write_parquet(frame: Frame, path: str, labels: bool = True) -> None:
    frame.to_spark(labels).write.mode("overwrite").parquet(path)


def to_json(frame: Frame) -> str:
    """Labels, values, name and header levels as one JSON text, with the columns' types."""

    def parts(fields):
        if not fields:
            return []
        # the value alone, as JSON
        cols = [F.to_json(F.struct(F.col(f.id).alias("v")), {"ignoreNullFields": "false"}).alias(f"c{k}") for k, f in enumerate(fields)]
        rows = frame._sdf.orderBy(*directed(frame.order)).select(*cols).collect()
        return [{"name": f.name, "type": frame.kind(f).simpleString(), "slice": [r[k][5:-1] for r in rows], "isNull": [r[k] == '{"v":null}' for r in rows]} for k, f in enumerate(fields)]

    return json.dumps({"labels": parts(frame.labels), "values": parts(frame.cols), "name": frame.name, "colLevelNames": list(frame.level_names)})


def to_dataclasses(frame: Frame, kind: type, strict: bool = False) -> tuple[list[Any], list[list[bool]]]:
    """Instances of ``kind`` and a mask of nulls, row by row. A field takes the column of its name (or its metadata's); with ``strict``
    every column must have a field. A null gives the field's type's empty value."""
    fields = dataclasses.fields(kind)
    names = [f.metadata.get("name", f.name) for f in fields]
    have = {f.name: f for f in reversed(frame.fields)}
    for n in names:
        if n not in have:
            raise KeyError(f"no column {n!r} for a field")
    if strict and (extra := [f.name for f in frame.cols if f.name not in names]):
        raise ValueError(f"columns without a field: {extra}")
    rows = frame._sdf.orderBy(*directed(frame.order)).select(*(F.col(have[n].id).alias(f"c{k}") for k, n in enumerate(names))).collect()
    empty = {"str": "", "int": 0, "float": 0.0, "bool": False}
    kinds = [f.type if isinstance(f.type, str) else getattr(f.type, "__name__", "") for f in fields]
    items = []
    for r in rows:
        for v, k, n in zip(r, kinds, names, strict=True):
            if v is not None and k in empty and type(v).__name__ != k:
                raise TypeError(f"column {n!r} has {type(v).__name__}, the field {k}")
        items.append(kind(*(empty.get(k) if v is None else v for v, k in zip(r, kinds, strict=True))))
    return items, [[v is None for v in r] for r in rows]


def equal_records(frame: Frame, want: Sequence[Sequence[str]] | str, labels: bool = True) -> tuple[bool, list[tuple[int, int, str, str]]]:
    """Whether the frame's records are those wanted (records or CSV text), and each difference as (row, column, got, want)."""
    want = [r for r in csv.reader(io.StringIO(want))] if isinstance(want, str) else [list(r) for r in want]
    got, out = to_records(frame, labels), []
    for i in range(max(len(got), len(want))):
        a, b = (x[i] if i < len(x) else [] for x in (got, want))
        for k in range(max(len(a), len(b))):
            u, v = (x[k] if k < len(x) else "" for x in (a, b))
            if u != v or (k < len(a)) != (k < len(b)):
                out.append((i, k, u, v))
    return not out, out


def equal_structs(frame: Frame, want: Sequence[Any]) -> tuple[bool, str]:
    """Whether the frame holds those instances, and the first difference."""
    got, _ = to_dataclasses(frame, type(want[0]))
    for i, (a, b) in enumerate(zip(got, want, strict=False)):
        if a != b:
            return False, f"row {i}: {a} is not {b}"
    return len(got) == len(want), "" if len(got) == len(want) else f"{len(got)} rows, not {len(want)}"


def equal_frames(a: Frame, b: Frame) -> bool:
    """Same names, types, header levels and rows in order."""
    alike = [f.name for f in a.fields] == [f.name for f in b.fields] and a.name == b.name and a.level_names == b.level_names and len(a.labels) == len(b.labels)
    return alike and [a.kind(f) for f in a.fields] == [b.kind(f) for f in b.fields] and a.rows() == b.rows()


def equal_groups(a: Grouped, b: Grouped) -> bool:
    """Same keys in the same order, with the same rows."""
    return a.get_labels() == b.get_labels() and [f.name for f in a.keys] == [f.name for f in b.keys] and a.aligned == b.aligned and equal_frames(a.frame_(), b.frame_())


class Writer:
    """Anything with ``write(frame)``: ``Frame.write`` takes it. This one holds a function of this module and its arguments."""

    def __init__(self, function, *args, **kwargs):
        self.function, self.args, self.kwargs = function, args, kwargs

    def write(self, frame: Frame) -> Any:
        return self.function(frame, *self.args, **self.kwargs)


def mock_value(kind: str, seed: int) -> Column:
    """A random value of a type as text: a number of two places, a word of three to nine letters, a moment of the years 2000 to 2029."""
    x, y = F.rand(seed), F.rand(seed + 1)
    moment = F.timestamp_seconds(F.lit(946_684_800) + F.floor(x * (30 * 365 * 86_400)))
    if kind == casts.FLOAT:
        return F.format_string("%.2f", x * 1000)
    if kind == casts.STRING:
        return F.substring(F.translate(F.sha1(x.cast("string")), "0123456789", "ghijklmnop"), F.lit(1), (F.lit(3) + F.floor(y * 7)).cast("int"))
    return F.date_format(moment, {casts.DATE: "yyyy-MM-dd", casts.DATETIME: "yyyy-MM-dd HH:mm:ss", casts.TIME: "HH:mm:ss"}[kind])


def write_mock_csv(spark: SparkSession, sample: str, path: str, n: int, seed: int = 0, null_share: float = 0.1) -> None:
    """``n`` rows with the columns of a sample CSV text and random values of the types that its columns seem to have; an empty field is a null."""
    heads, *rows = csv.reader(io.StringIO(sample))
    cols = []
    for k, name in enumerate(heads):
        value = mock_value(casts.infer([r[k] for r in rows[:10]]), seed + 3 * k)
        cols.append(F.when(F.rand(seed + 3 * k + 2) < null_share, F.lit("")).otherwise(value).alias(name))
    spark.range(n).select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
