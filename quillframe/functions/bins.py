"""Bins of a number as one conditional expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def binned(v: Column, edges: Sequence[float], and_less: bool = False, and_more: bool = False, names: Sequence[str] | None = None, left_closed: bool = False) -> Column:
    """The name of the interval of ``v``: (a, b], or [a, b) if ``left_closed``; null outside, unless an open end takes it.

    Without ``names``: ``a-b``, and ``<=a``, ``>b`` for the open ends (``<a``, ``>=b`` if ``left_closed``).
    """
    if len(edges) < 2 or list(edges) != sorted(set(edges)):
        raise ValueError("edges must be two or more ascending numbers")
    want = len(edges) - 1 + and_less + and_more
    if names is not None and len(names) != want:
        raise ValueError(f"{len(names)} names for {want} bins")
    auto = [*([f"{'<' if left_closed else '<='}{_text(edges[0])}"] if and_less else []), *(f"{_text(a)}-{_text(b)}" for a, b in zip(edges, edges[1:], strict=False)), *([f"{'>=' if left_closed else '>'}{_text(edges[-1])}"] if and_more else [])]
    below = (lambda e: v < F.lit(float(e))) if left_closed else (lambda e: v <= F.lit(float(e)))
    tests = [below(e) for e in edges]
    picked = list(names or auto)
    out = F.when(v.isNull(), F.lit(None).cast("string")).when(tests[0], F.lit(picked.pop(0)) if and_less else F.lit(None).cast("string"))
    for t in tests[1:]:
        out = out.when(t, F.lit(picked.pop(0)))
    return out.otherwise(F.lit(picked.pop(0)) if and_more else F.lit(None).cast("string"))
