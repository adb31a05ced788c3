"""Sources: records, columns, CSV, JSON, dataclasses, matrices, parquet."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.config import DEFAULT, Options
from quillframe.functions import casts
from quillframe.operators.blocks import POS, directed, read_order
from quillframe.operators.frame import Field, Frame, Series, new_id


def _assembled(spark: SparkSession, rows: list[tuple], kinds: Sequence[str], names: Sequence[str], labels: int, name: str, level_names: Sequence[str], options: Options) -> Frame:
    """A frame of local rows; their order is that of the list. Names may repeat."""
    ids, o = [new_id() for _ in names], new_id()
    schema = ", ".join([*(f"{i} {k}" for i, k in zip(ids, kinds, strict=True)), f"{o} long"])
    sdf = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    sdf = sdf.withColumns({i: casts.normalised(F.col(i), sdf.schema[i].dataType, options) for i in ids}) if ids else sdf
    fields = [Field(n, i) for n, i in zip(names, ids, strict=True)]
    lab = fields[:labels] or [Field("*0", o)]
    return Frame(sdf, lab, fields[labels:], [(o, True)], name, level_names, options)


def _default_names(count: int, labels: int) -> list[str]:
    return [*(f"*{k}" for k in range(labels)), *(str(k) for k in range(count - labels))]


def read_records(spark: SparkSession, records: Sequence[Sequence[str]], header_rows: int = 1, label_levels: int = 0, by_column: bool = False, infer_types: bool = False, blank_as_null: bool = False, name: str = "", options: Options = DEFAULT) -> Frame:
    """A frame of texts. Several header rows make header levels. Rows of unequal length are an error."""
    rows = [list(r) for r in records]
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("records must be there and of one length")
    if by_column:
        rows = [list(r) for r in zip(*rows, strict=True)]
    heads, rows = rows[:header_rows], [tuple(None if blank_as_null and x == "" else x for x in r) for r in rows[header_rows:]]
    width = len(heads[0]) if heads else len(rows[0])
    if label_levels >= width:
        raise ValueError("a frame needs a column")
    names = [options.separator.join(h[k] for h in heads) for k in range(width)] if heads else _default_names(width, label_levels)
    if header_rows > 1:  # a label has the last row's name
        names[:label_levels] = [heads[-1][k] for k in range(label_levels)]
    levels = [f"*{k}" for k in range(header_rows)] if header_rows > 1 else []
    out = _assembled(spark, rows, ["string"] * width, names, label_levels, name, levels, options)
    return inferred(out) if infer_types else out


def inferred(frame: Frame) -> Frame:
    """Columns cast to the majority type of their first ten texts."""
    fields = [f for f in frame.fields if isinstance(frame.kind(f), T.StringType)]
    some = frame._sdf.orderBy(*directed(frame.order)).limit(10).select(*(f.id for f in fields)).collect()
    kinds = {f.id: casts.infer([r[k] for r in some if r[k] is not None]) for k, f in enumerate(fields)}
    return frame.cast({i: k for i, k in kinds.items() if k != casts.STRING})


def read_rows(spark: SparkSession, records: Sequence[Sequence[Any]], header_rows: int = 1, label_levels: int = 0, by_column: bool = False, name: str = "", options: Options = DEFAULT) -> Frame:
    """A frame of Python values; a column of several types becomes text."""
    rows = [list(r) for r in records]
    if by_column:
        rows = [list(r) for r in zip(*rows, strict=True)]
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("records must be there and of one length")
    heads, rows = rows[:header_rows], rows[header_rows:]
    names = [options.separator.join(str(h[k]) for h in heads) for k in range(len(heads[0]))] if heads else _default_names(len(rows[0]), label_levels)
    return read_columns(spark, dict(enumerate(zip(*rows, strict=True))) if rows else {k: [] for k in range(len(names))}, label_levels, name, options, names)


def _column_kind(values: Sequence[Any]) -> tuple[str, list]:
    from datetime import date, datetime

    some = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in some) and some:
        return "boolean", list(values)
    if all(isinstance(v, (int, np.integer)) and not isinstance(v, bool) for v in some) and some:
        return "long", [None if v is None else int(v) for v in values]
    if all(isinstance(v, (int, float, np.number)) and not isinstance(v, bool) for v in some) and some:
        return "double", [None if v is None else float(v) for v in values]
    if all(isinstance(v, datetime) for v in some) and some:
        return ("timestamp" if any(v.tzinfo for v in some) else "timestamp_ntz"), list(values)
    if all(isinstance(v, date) and not isinstance(v, datetime) for v in some) and some:
        return "date", list(values)
    if all(isinstance(v, (bytes, bytearray)) for v in some) and some:
        return "binary", list(values)
    if all(isinstance(v, (list, tuple)) for v in some) and some:
        kind, _ = _column_kind([x for v in some for x in v])
        return f"array<{kind}>", [None if v is None else list(v) for v in values]
    return "string", [None if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in values]


def read_columns(spark: SparkSession, columns: dict[Any, Sequence], label_levels: int = 0, name: str = "", options: Options = DEFAULT, names: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> Frame:
    """A frame of columns by name, the first ``label_levels`` of them labels. None and NaN are null."""
    values = list(columns.values())
    if not values or len({len(v) for v in values}) > 1:
        raise ValueError("columns must be there and of one length")
    found = [_column_kind(v) for v in values]
    kinds = list(kinds or (k for k, _ in found))
    return _assembled(spark, list(zip(*(v for _, v in found), strict=True)), kinds, list(names or map(str, columns)), label_levels, name, (), options)


def csv_dimensions(text: str, separator: str = ",") -> tuple[int, int]:
    """Rows, header included, and columns of a CSV text. Rows of unequal length are an error."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if r]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows must be of one length")
    return len(rows), len(rows[0]) if rows else 0


def read_series(spark: SparkSession, values: Sequence, labels: dict[str, Sequence] | None = None, name: str = "", options: Options = DEFAULT) -> Series:
    """A series of local values under labels by name, or under ordinals."""
    labels = labels or {}
    return read_columns(spark, {**{("label", k): v for k, v in labels.items()}, "values": values}, len(labels), name, options, [*labels, name]).series()


def read_csv(spark: SparkSession, path: str, header_rows: int = 1, label_levels: int = 0, separator: str = ",", comment: str | None = None, trim: bool = False, infer_types: bool = False, blank_as_null: bool = False, name: str = "", options: Options = DEFAULT) -> Frame:
    """A frame of a CSV file's texts. Rows of unequal length are an error; an empty field is an empty text unless ``blank_as_null``.

    The header rows are read on the driver; the rest is one distributed scan in the file's order.
    """
    lines = spark.read.text(path)
    top = [r[0] for r in lines.limit(max(1, header_rows) + 20).collect() if not (comment and r[0].startswith(comment))]
    import csv

    heads = list(csv.reader(top[: max(1, header_rows)], delimiter=separator, skipinitialspace=trim))
    width = len(heads[0])
    if any(len(h) != width for h in heads):
        raise ValueError("header rows must be of one length")
    ids, o, bad = [new_id() for _ in range(width)], new_id(), new_id()
    schema = ", ".join([*(f"{i} string" for i in ids), f"{bad} string"])
    read = spark.read.schema(schema).option("sep", separator).option("header", header_rows == 1).option("ignoreLeadingWhiteSpace", trim).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True)
    if comment:
        read = read.option("comment", comment)
    sdf = read.csv(path).withColumn(o, F.monotonically_increasing_id())
    if header_rows > 1:  # further header rows come first in the file
        sdf = sdf.filter(F.col(o) >= header_rows)
    empty = F.lit(None).cast("string") if blank_as_null else F.lit("")
    kind = T.StringType()

    def checked(df: DataFrame, row: str) -> DataFrame:
        """Texts by the null rules; a row of another length is an error once ``row`` is read."""
        whole = F.when(F.col(bad).isNull(), F.col(row)).otherwise(F.raise_error(F.concat(F.lit("a row of another length: "), F.col(bad))).cast("long"))
        return df.withColumn(row, whole).drop(bad).withColumns({i: casts.normalised(F.coalesce(F.col(i), empty), kind, options) for i in ids})

    names = [options.separator.join(h[k] for h in heads) for k in range(width)] if header_rows else _default_names(width, label_levels)
    if header_rows > 1:
        names[:label_levels] = [heads[-1][k] for k in range(label_levels)]
    fields = [Field(n, i) for n, i in zip(names, ids, strict=True)]
    levels = [f"*{k}" for k in range(header_rows)] if header_rows > 1 else []
    if label_levels or header_rows > 1:
        out = Frame(checked(sdf, o), fields[:label_levels], fields[label_levels:], [(o, True)], name, levels, options)
        out = out if label_levels else out._default_label()
    else:
        b = read_order(sdf, o)  # counts rows without parsing them
        out = Frame(sdf, (), fields, [(o, True)], name, levels, options)._ordinals(replace(b, df=checked(b.df, POS)))
    return inferred(out) if infer_types else out


def read_dataclasses(spark: SparkSession, items: Sequence[Any], nulls: Sequence[Sequence[bool]] | None = None, label_levels: int = 0, name: str = "", options: Options = DEFAULT) -> Frame:
    """A frame of dataclass instances of one class; a field's metadata ``name`` renames it. ``nulls``: a mask, row by row."""
    if not items:
        raise ValueError("no items")
    fields = dataclasses.fields(items[0])
    cols = {f.metadata.get("name", f.name): [None if nulls and nulls[i][k] else getattr(x, f.name) for i, x in enumerate(items)] for k, f in enumerate(fields)}
    return read_columns(spark, cols, label_levels, name, options)


def read_matrix(spark: SparkSession, matrix: np.ndarray, name: str = "", options: Options = DEFAULT) -> Frame:
    """A frame of doubles named 0, 1, ..."""
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    return _assembled(spark, [tuple(map(float, r)) for r in matrix], ["double"] * matrix.shape[1], [str(k) for k in range(matrix.shape[1])], 0, name, (), options)


def read_json(spark: SparkSession, text: str, options: Options = DEFAULT) -> Frame:
    """What ``to_json`` wrote; types survive."""
    x = json.loads(text)
    parts = [*x["labels"], *x["values"]]
    sdf_kinds = [p["type"] for p in parts]
    ids, o = [new_id() for _ in parts], new_id()
    texts = list(zip(*(p["slice"] for p in parts), strict=True))
    sdf = spark.createDataFrame([(*r, k) for k, r in enumerate(texts)], ", ".join([*(f"{i} string" for i in ids), f"{o} long"]))
    sdf = sdf.withColumns({i: F.from_json(F.concat(F.lit('{"v":'), F.col(i), F.lit("}")), f"v {k}")["v"] for i, k in zip(ids, sdf_kinds, strict=True)})
    fields = [Field(p["name"], i) for p, i in zip(parts, ids, strict=True)]
    n = len(x["labels"])
    return Frame(sdf, fields[:n], fields[n:], [(o, True)], x["name"], x["colLevelNames"], options)


def read_parquet(spark: SparkSession, path: str, labels: Sequence[str] = (), order_by: Sequence[str] = (), name: str = "", options: Options = DEFAULT) -> Frame:
    return Frame.from_spark(spark.read.parquet(path), labels, order_by, name, options)


class Reader:
    """Anything with ``read(spark)`` that gives a frame: ``Frame.read`` takes it. This one holds a function of this module and its arguments."""

    def __init__(self, function, *args, **kwargs):
        self.function, self.args, self.kwargs = function, args, kwargs

    def read(self, spark: SparkSession) -> Frame:
        return self.function(spark, *self.args, **self.kwargs)
