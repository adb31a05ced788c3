"""Rows to columns: promotion of a label to headers, pivot tables, transposition.

The names of new columns are data, so they are collected first, in order of first appearance: at most ``spark.sql.pivotMaxValues`` of them,
beyond which these operators raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import casts
from quillframe.operators import blocks as B
from quillframe.operators.frame import Field, Frame, new_id
from quillframe.operators.grouped import NUMBERS, reducer

#: New columns up to which a pivot is one aggregation.
WIDE = 64


def _headers(frame: Frame, text: Column) -> list[str]:
    most = int(frame.spark.conf.get("spark.sql.pivotMaxValues"))
    got = frame._sdf.groupBy(text.alias("t")).agg(F.min(frame._order_key()).alias("__first")).orderBy("__first").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} different values would become columns")
    return [r["t"] for r in got]


def _text(frame: Frame, f: Field) -> Column:
    return F.coalesce(casts.to_text(F.col(f.id), frame.kind(f)), F.lit("(null)"))


def promote(frame: Frame, name: str) -> Frame:
    """Values of ``name`` become the upper header level; rows whose other labels are equal merge, the last one's values count."""
    frame = frame._settled()
    f = frame.field(name)
    labels, cols = [x for x in frame.labels if x != f], [x for x in frame.cols if x != f]
    if not labels or not cols:
        raise ValueError("a label and a column must be left")
    values = _headers(frame, _text(frame, f))
    key = frame._order_key()
    made = [(v, c, new_id()) for v in values for c in cols]
    aggs = [F.max_by(F.col(c.id), F.when(_text(frame, f) == v, key)).alias(i) for v, c, i in made]
    o = new_id()
    sdf = frame._sdf.groupBy(*(x.id for x in labels)).agg(*aggs, F.min(key).alias(o))
    sep = frame.options.separator
    levels = [f.name, *(frame.level_names or ("*0",))]
    return frame._new(sdf, labels=labels, cols=[Field(f"{v}{sep}{c.name}", i) for v, c, i in made], order=[(o, True)], level_names=levels, kind=Frame)


def pivot_table(frame: Frame, labels: str, columns: str, values: str, how: str = "sum") -> Frame:
    """One row for each value of ``labels``, one column for each of ``columns``, ``how`` of ``values`` in it. Rows and columns by first appearance."""
    if how not in (*NUMBERS, "count"):
        raise ValueError(f"unknown aggregation {how!r}")
    frame = frame._settled()
    row, col, val = frame.field(labels), frame.field(columns), frame.field(values)
    names = _headers(frame, _text(frame, col))
    o, ids = new_id(), {n: new_id() for n in names}
    text, value = _text(frame, col), F.col(val.id)
    if len(names) <= WIDE:  # one aggregation: a conditional aggregate for each column
        cells = [reducer(how, F.when(text == n, value), frame.kind(val), frame).alias(i) for n, i in ids.items()]
        sdf = frame._sdf.groupBy(row.id).agg(*cells, F.min(frame._order_key()).alias(o))
    else:  # first by row and column, so that work doesn't grow with rows times columns
        first = frame._sdf.groupBy(row.id).agg(F.min(frame._order_key()).alias(o))
        wide = frame._sdf.select(row.id, text.alias("__h"), val.id).groupBy(F.col(row.id).alias("__r")).pivot("__h", names).agg(reducer(how, value, frame.kind(val), frame))
        sdf = first.join(wide.toDF("__r", *ids.values()), F.col(row.id).eqNullSafe(F.col("__r"))).drop("__r")
    return frame._new(sdf, labels=[row], cols=[Field(n, i) for n, i in ids.items()], order=[(o, True)], name=f"{how}_{frame.name}" if frame.name else how, level_names=[col.name], kind=Frame)


def transpose(frame: Frame) -> Frame:
    """Columns become rows. Labels become headers (joined by the separator) and header levels become labels; values of several types, text."""
    most, b = int(frame.spark.conf.get("spark.sql.pivotMaxValues")), frame._positions()
    if b.size > most:
        raise ValueError(f"{b.size} rows would become columns; at most {most} can")
    sep, kinds = frame.options.separator, [frame.kind(f) for f in frame.cols]
    names = [r[0] for r in b.df.orderBy(B.POS).select(F.concat_ws(sep, *(_text(frame, f) for f in frame.labels))).collect()]
    same = len({k.simpleString() for k in kinds}) == 1
    levels = [f.name.split(sep) if frame.num_col_levels() > 1 else [f.name] for f in frame.cols]
    depth = frame.num_col_levels()
    cells = F.array(*(F.struct(F.lit(k).alias("o"), *(F.lit(levels[k][d] if d < len(levels[k]) else "").alias(f"l{d}") for d in range(depth)), (F.col(f.id) if same else casts.to_text(F.col(f.id), kinds[k])).alias("v")) for k, f in enumerate(frame.cols)))
    long = b.df.select(B.POS, F.explode(cells).alias("x")).select(B.POS, "x.*")
    keys = ["o", *(f"l{d}" for d in range(depth))]
    wide = long.groupBy(*keys).pivot(B.POS, list(range(b.size))).agg(F.first("v"))
    ids, o, labels = [new_id() for _ in names], new_id(), [Field(frame.level_names[d] if d < len(frame.level_names) else f"*{d}", new_id()) for d in range(depth)]
    wide = wide.toDF(o, *(f.id for f in labels), *ids)
    return frame._new(wide, labels=labels, cols=[Field(n, i) for n, i in zip(names, ids, strict=True)], order=[(o, True)], level_names=[f.name for f in frame.labels], kind=Frame)
