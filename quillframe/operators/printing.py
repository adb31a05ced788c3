"""Frames as text tables: the first and last rows, cells of a bounded width, repeated labels left blank."""

from __future__ import annotations

from quillframe.functions import casts
from quillframe.operators.frame import Frame


def table(frame: Frame) -> str:
    from pyspark.sql import functions as F

    o = frame.options
    fields = frame.fields[: len(frame.labels) + o.max_columns]
    texts = frame._new(frame._sdf.withColumns({f.id: casts.to_text(F.col(f.id), frame.kind(f)) for f in fields if f.id not in {c for c, _ in frame.order}}))
    pick = lambda x: [["(null)" if v is None else str(v) for v in r] for r in x._sdf.orderBy(*_order(x)).select(*(f.id for f in fields)).collect()]
    n = len(frame)
    half = o.max_rows // 2
    rows = pick(texts) if n <= o.max_rows else [*pick(texts.head(half)), ["..."] * len(fields), *pick(texts.tail(half))]
    if o.merge_repeats:
        for k in range(len(frame.labels)):
            last = None
            for r in rows:
                r[k], last = ("", last) if r[k] == last and k < len(frame.labels) - 1 else (r[k], r[k])
    head = ["-" if f.name.startswith("*") else f.name for f in fields]
    cut = (lambda x: x) if o.wrap_lines else (lambda x: x if len(x) <= o.max_cell_width else x[: o.max_cell_width - 3] + "...")
    cells = [[cut(x) for x in r] for r in (head, *rows)]
    width = [max(len(r[k]) for r in cells) for k in range(len(fields))]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    show = lambda r: "|" + "|".join(f" {x:>{w}} " for x, w in zip(r, width, strict=True)) + "|"
    more = len(frame.cols) - (len(fields) - len(frame.labels))
    out = [line, show(cells[0]), line, *(show(r) for r in cells[1:]), line]
    if more > 0:
        out.append(f"{more} more columns")
    if frame.name:
        out.append(f"name: {frame.name}")
    return "\n".join(out)


def _order(frame: Frame) -> list:
    from quillframe.operators.blocks import directed

    return directed(frame.order)
