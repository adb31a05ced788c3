"""Labelled, ordered tables over Spark DataFrames.

A ``Frame`` has label levels and value columns, each with a user's name (repeats are legal) and a column of its own in the inner DataFrame,
and a total order of its rows. It is immutable: every operator gives a new frame over a new lazy plan. Null is SQL's null. The order
is a list of key columns; operators that don't observe it leave it out of their plans.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.config import DEFAULT, Options
from quillframe.functions import casts
from quillframe.functions.bins import binned
from quillframe.functions.resample import Resampler, resampled
from quillframe.operators import blocks as B

_ids = itertools.count()
Predicate = Callable[[Column], Column]


def new_id() -> str:
    return f"q{next(_ids)}"


@dataclass(frozen=True)
class Field:
    name: str
    id: str
    #: The column as the source has it, where the values' null rules are an expression over it: tests of it can reach the scan.
    raw: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Sorter:
    name: str
    kind: str = casts.STRING
    descending: bool = False


@dataclass(frozen=True)
class NullFiller:
    """The first that is set counts; else nulls become ``value`` and the column is made a number."""

    forward: bool = False
    backward: bool = False
    zero: bool = False
    value: float = 0.0


def _bare(fields: Sequence[Field]) -> list[Field]:
    """Without the source's columns, which blocks don't hold."""
    return [Field(f.name, f.id) for f in fields]


def opaque(f: Callable[[pd.Series], pd.Series], kind: str | None = None) -> Callable[[pd.Series], pd.Series]:
    """Marks a function of pandas Series (not of Columns); ``kind`` is the Spark type it returns, by default its input's."""
    f._opaque, f._kind = True, kind
    return f


def unique_names(names: Sequence[str]) -> list[str]:
    """The n-th repeat of a name gets the suffix _n, and another where that is taken."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for x in names:
        k = seen.get(x, 0)
        y = x if not k else f"{x}_{k}"
        while y in out:
            k += 1
            y = f"{x}_{k}"
        seen[x] = k + 1
        out.append(y)
    return out


_ZERO = {T.StringType: "", T.BooleanType: False}


def zero_of(kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if type(kind) in _ZERO:
        return F.lit(_ZERO[type(kind)])
    if casts.is_time(kind):
        return F.lit("0001-01-01").cast(kind)
    return F.lit(None).cast(kind)


class Frame:
    def __init__(self, sdf: DataFrame, labels: Sequence[Field], cols: Sequence[Field], order: Sequence[tuple[str, bool]], name: str = "", level_names: Sequence[str] = (), options: Options = DEFAULT):
        self._sdf, self.labels, self.cols, self.order = sdf, tuple(labels), tuple(cols), tuple(order)
        self.name, self.level_names, self.options = name, tuple(level_names), options
        self._blocks: B.Blocks | None = None

    # ---- making ----

    @classmethod
    def from_spark(cls, sdf: DataFrame, labels: Sequence[str] = (), order_by: Sequence[str] = (), name: str = "", options: Options = DEFAULT) -> Frame:
        """``order_by``: columns of a total order. Without them the order is that in which Spark reads the rows.

        Without ``labels`` there is one level, the row's ordinal: by one count of the rows of each partition where rows come in the order of
        reading, else by a sort.
        """
        names = [c for c in sdf.columns if c not in labels]
        for x in (*labels, *order_by):
            if x not in sdf.columns:
                raise KeyError(x)
        fields = {c: Field(c, new_id()) for c in sdf.columns}
        kinds = {f.name: f.dataType for f in sdf.schema}
        made = {c: casts.normalised(F.col(f"`{c}`"), kinds[c], options) for c in fields}
        ruled = [c for c in fields if isinstance(kinds[c], (T.DoubleType, T.StringType))]
        fields |= {c: Field(c, fields[c].id, new_id()) for c in ruled}
        picked = sdf.select(*(v.alias(fields[c].id) for c, v in made.items()), *(F.col(f"`{c}`").alias(fields[c].raw) for c in ruled))
        if order_by:
            order = [(fields[c].id, True) for c in order_by]
        else:
            o = new_id()
            picked, order = picked.withColumn(o, F.monotonically_increasing_id()), [(o, True)]
        out = cls(picked, [fields[c] for c in labels], [fields[c] for c in names], order, name, options=options)
        return out if labels else out._ordinals(B.read_order(picked, o)) if not order_by else out._default_label()

    def _default_label(self) -> Frame:
        """The row's position as the only label."""
        return self._ordinals(self._positions())

    def _ordinals(self, b: B.Blocks) -> Frame:
        f = Field("*0", new_id())
        have = set(b.df.columns)
        cols = [x if x.raw in have else Field(x.name, x.id) for x in self.cols]
        return self._new(b.df.withColumnRenamed(B.POS, f.id).drop(B.ROW, B.BLOCK), labels=[f], cols=cols, order=[(f.id, True)])

    def _new(self, sdf: DataFrame | None = None, labels=None, cols=None, order=None, name=None, level_names=None, kind: type | None = None) -> Any:
        pick = lambda a, b: b if a is None else a
        return (kind or type(self))(pick(sdf, self._sdf), pick(labels, self.labels), pick(cols, self.cols), pick(order, self.order), pick(name, self.name), pick(level_names, self.level_names), self.options)

    @classmethod
    def read(cls, spark: SparkSession, reader: Any) -> Frame:
        """What a reader, anything with ``read(spark)``, gives."""
        return reader.read(spark)

    # ---- leaving ----

    def write(self, writer: Any) -> Any:
        """Hands the frame to a writer, anything with ``write(frame)``."""
        return writer.write(self)

    @property
    def spark(self) -> SparkSession:
        return self._sdf.sparkSession

    def to_spark(self, labels: bool = True, ordered: bool = False) -> DataFrame:
        """A plain DataFrame under the user's names, repeats renamed; no order unless asked for."""
        fields = [*(self.labels if labels else ()), *self.cols]
        names = unique_names([f.name for f in fields])
        sdf = self._sdf.orderBy(*B.directed(self.order)) if ordered else self._sdf
        return sdf.select(*(F.col(f.id).alias(n) for f, n in zip(fields, names, strict=True)))

    def rows(self, labels: bool = True) -> list[tuple]:
        """All rows in order, on the driver."""
        return [tuple(r) for r in self.to_spark(labels, True).collect()]

    def __iter__(self) -> Iterator[dict[str, Any]]:
        """Rows in order, by name; the left-most of a repeated name counts."""
        fields = {}
        for f in self.fields:
            fields.setdefault(f.name, f)
        for r in self._sdf.orderBy(*B.directed(self.order)).select(*(f.id for f in fields.values())).toLocalIterator():
            yield dict(zip(fields, r, strict=True))

    # ---- names ----

    @property
    def fields(self) -> list[Field]:
        return [*self.labels, *self.cols]

    def field(self, name: str) -> Field:
        """The first of labels, then columns, with that name (or that id)."""
        for f in self.fields:
            if name in (f.name, f.id):
                return f
        raise KeyError(f"{name!r} is neither a label nor a column of {[f.name for f in self.fields]}")

    def kind(self, f: Field | str) -> T.DataType:
        return self._sdf.schema[f.id if isinstance(f, Field) else self.field(f).id].dataType

    def list_col_names(self) -> list[str]:
        return [f.name for f in self.cols]

    def list_label_names(self) -> list[str]:
        return [f.name for f in self.labels]

    def num_col_levels(self) -> int:
        return max(1, len(self.level_names))

    def list_col_names_at_level(self, level: int) -> list[str]:
        if not 0 <= level < self.num_col_levels():
            raise IndexError(f"level {level} of {self.num_col_levels()}")
        return [f.name.split(self.options.separator)[level] if self.num_col_levels() > 1 else f.name for f in self.cols]

    def has_labels(self, *names: str) -> None:
        for x in names:
            if x not in self.list_label_names():
                raise KeyError(f"no label {x!r}")

    def has_cols(self, *names: str) -> None:
        for x in names:
            if x not in self.list_col_names():
                raise KeyError(f"no column {x!r}")

    def has_type(self, kind: str) -> tuple[list[int], list[int]]:
        """Positions of labels and of columns of a Spark type."""
        return tuple([k for k, f in enumerate(x) if self.kind(f).simpleString() == kind] for x in (self.labels, self.cols))

    def name_of_label(self, n: int) -> str:
        return self.labels[n].name if 0 <= n < len(self.labels) else "-out of range-"

    def name_of_col(self, n: int) -> str:
        return self.cols[n].name if 0 <= n < len(self.cols) else "-out of range-"

    def index_of(self, name: str, columns: bool = True) -> int:
        found = [k for k, f in enumerate(self.cols if columns else self.labels) if name in (f.name, f.id)]
        return found[0] if found else -1

    def ids(self, labels: bool = True) -> list[str]:
        """Names that never repeat and go wherever a name goes."""
        return [f.id for f in (self.fields if labels else self.cols)]

    def unpack_ids(self, *names: str) -> list[str]:
        """Ids of the columns (or labels) named, in that order; without names those of all columns."""
        return [self.field(n).id for n in names] or self.ids(False)

    @property
    def num_columns(self) -> int:
        return len(self.cols)

    @property
    def num_levels(self) -> int:
        return len(self.labels)

    def set_name(self, name: str):
        return self._new(name=name)

    def set_label_names(self, names: Sequence[str]):
        if len(names) != len(self.labels):
            raise ValueError(f"{len(names)} names for {len(self.labels)} labels")
        return self._new(labels=[Field(n, f.id, f.raw) for n, f in zip(names, self.labels, strict=True)])

    def set_col_names(self, names: Sequence[str]):
        if len(names) != len(self.cols):
            raise ValueError(f"{len(names)} names for {len(self.cols)} columns")
        return self._new(cols=[Field(n, f.id, f.raw) for n, f in zip(names, self.cols, strict=True)])

    def deduplicate_names(self):
        names = unique_names([f.name for f in self.fields])
        made = [Field(n, f.id, f.raw) for n, f in zip(names, self.fields, strict=True)]
        return self._new(labels=made[: len(self.labels)], cols=made[len(self.labels) :])

    def copy(self):
        return self

    def in_place(self):
        return Mutator(self)

    def attempt(self) -> Attempt:
        return Attempt(self)

    # ---- shape and values ----

    def __len__(self) -> int:
        return self._sdf.count()

    def at(self, row: int, column: int = 0) -> Any:
        """The value at a position; None where there is none."""
        if not 0 <= column < len(self.cols) or row < 0:
            return None
        cell = self.cols[column].id
        if row < B.FEW:  # a bounded top-k
            got = self._sdf.orderBy(*B.directed(self.order)).select(cell).offset(row).limit(1).collect()
        else:
            got = self._positions().df.filter(F.col(B.POS) == row).select(cell).collect()
        return got[0][0] if got else None

    def get_labels(self) -> list[list]:
        got = self._sdf.orderBy(*B.directed(self.order)).select(*(f.id for f in self.labels)).collect()
        return [[r[k] for r in got] for k in range(len(self.labels))]

    def _positions(self) -> B.Blocks:
        """Labels, columns and order keys in blocks, dealt once."""
        if self._blocks is None:
            self._blocks = B.blocks_of(self._sdf.select(*dict.fromkeys([*(f.id for f in self.fields), *(c for c, _ in self.order)])), self.order)
        return self._blocks

    def _placed(self, b: B.Blocks, sdf: DataFrame | None = None, **more):
        """A frame over ``sdf`` (the blocks' rows by default) that is ordered by position."""
        o = new_id()
        sdf = (b.df if sdf is None else sdf).withColumnRenamed(B.POS, o).drop(B.ROW, B.BLOCK)
        return self._new(sdf, labels=_bare(self.labels), cols=_bare(self.cols), order=[(o, True)], **more)

    def cast(self, kinds: Mapping[str, str]):
        """New types by name. What can't be cast is null; with the option ``warnings``, one job counts these and warns."""
        made = {self.field(n).id: casts.cast(F.col(self.field(n).id), self.kind(n), k, self.options) for n, k in kinds.items()}
        if self.options.warnings and made:
            lost = self._sdf.agg(*(F.count_if(F.col(i).isNotNull() & c.isNull()).alias(i) for i, c in made.items())).first()
            for n, i in zip(kinds, made, strict=True):
                if lost[i]:
                    warnings.warn(f"{lost[i]} values of {n!r} are no {kinds[n]} and become null", stacklevel=2)
        return self._values(made)

    def _values(self, made: Mapping[str, Column]):
        """New values for columns by id. Key columns of the order keep theirs under another id."""
        sdf, order = self._sdf, list(self.order)
        for k, (c, up) in enumerate(order):
            if c in made:
                o = new_id()
                sdf, order[k] = sdf.withColumn(o, F.col(c)), (o, up)
        fresh = lambda fields: [Field(f.name, f.id) if f.id in made else f for f in fields]
        return self._new(sdf.withColumns(dict(made)), labels=fresh(self.labels), cols=fresh(self.cols), order=order)

    def __str__(self) -> str:
        from quillframe.operators.printing import table

        return table(self)

    # ---- projection ----

    def col(self, name: str) -> Series:
        f = self.field(name)
        labels = [x for x in self.labels if x.id != f.id] or list(self.labels)
        if f in self.labels:
            g = Field(f.name, new_id())
            return self._new(self._sdf.withColumn(g.id, F.col(f.id)), cols=[g], labels=self.labels, level_names=(), name=f.name, kind=Series)
        return self._new(cols=[f], labels=labels, level_names=(), name=f.name, kind=Series)

    __getitem__ = col

    def select(self, *names: str):
        """Columns by name, in that order (``Cols``)."""
        return self._new(cols=[self._column(n) for n in names], level_names=())

    def _column(self, name: str) -> Field:
        for f in self.cols:
            if name in (f.name, f.id):
                return f
        raise KeyError(f"no column {name!r}")

    def _label(self, name: str) -> Field:
        for f in self.labels:
            if name in (f.name, f.id):
                return f
        raise KeyError(f"no label {name!r}")

    def subset_cols(self, index: Sequence[int]):
        return self._new(cols=[self.cols[i] for i in index])

    def subset_labels(self, index: Sequence[int]):
        return self._new(labels=[self.labels[i] for i in index])

    def reorder_cols(self, names: Sequence[str]):
        return self._new(cols=[self._column(n) for n in names])

    def reorder_labels(self, names: Sequence[str]):
        return self._new(labels=[self._label(n) for n in names])

    def swap_labels(self, i: str, j: str):
        a, b = self._label(i), self._label(j)
        return self._new(labels=[b if f == a else a if f == b else f for f in self.labels])

    def filter_cols(self, test: Callable[[str], bool], level: int = 0):
        """Columns whose name at a header level passes."""
        keep = [f for f, n in zip(self.cols, self.list_col_names_at_level(level), strict=True) if test(n)]
        if not keep:
            raise ValueError("no column passes")
        return self._new(cols=keep)

    def _with(self, name: str, value: Any, labels: bool):
        own = self.labels if labels else self.cols
        old = next((f for f in own if name in (f.name, f.id)), None)
        put = lambda fields, **kw: self._new(**{("labels" if labels else "cols"): fields}, **kw)
        if isinstance(value, str):  # a new name
            if old is None:
                raise KeyError(name)
            return put([Field(value, f.id, f.raw) if f == old else f for f in own])
        f = Field(old.name if old else name, new_id())
        fields = [f if x == old else x for x in own] if old else [*own, f]
        if callable(value) and not isinstance(value, Column):
            value = value({x.name: F.col(x.id) for x in reversed(self.fields)})
        if isinstance(value, Column):
            return put(fields, sdf=self._sdf.withColumn(f.id, value))
        b = self._positions()
        values = list(value)
        if len(values) != b.size:
            raise ValueError(f"{len(values)} values for {b.size} rows")
        made = self.spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["__at", f.id])
        sdf = b.df.join(made, b.df[B.POS] == made["__at"]).drop("__at")
        return self._placed(b, sdf)._new(**{("labels" if labels else "cols"): _bare(fields)})

    def with_col(self, name: str, value: Any):
        """``value``: a text renames; a Column, a function of the columns by name, or one value for each row sets or appends."""
        return self._with(name, value, False)

    def with_label(self, name: str, value: Any):
        return self._with(name, value, True)

    def drop_col(self, name: str):
        f = self._column(name)
        if len(self.cols) == 1:
            raise ValueError("a frame needs a column")
        return self._new(cols=[x for x in self.cols if x != f])

    def drop_labels(self, name: str):
        f = self._label(name)
        if len(self.labels) == 1:
            raise ValueError("a frame needs a label")
        return self._new(labels=[x for x in self.labels if x != f])

    def relabel(self):
        return self._default_label()

    def set_as_labels(self, *names: str):
        moved = [self._column(n) for n in names]
        left = [f for f in self.cols if f not in moved]
        if not left:
            raise ValueError("a frame needs a column")
        return self._new(labels=[*self.labels, *moved], cols=left)

    def reset_labels(self, *names: str):
        """Labels become the last columns; a default label takes the place of the last one."""
        moved = [self._label(n) for n in names] or list(self.labels)
        left = [f for f in self.labels if f not in moved]
        out = self._new(labels=left, cols=[*self.cols, *(Field(f.name.removeprefix("*"), f.id) for f in moved)])
        return out if left else out._default_label()

    # ---- rows ----

    def subset(self, index: Sequence[int]):
        """Rows by position, in that order, repeats allowed."""
        b = self._positions()
        if any(not 0 <= i < b.size for i in index):
            raise IndexError(f"positions must be in 0..{b.size - 1}")
        o = new_id()
        want = self.spark.createDataFrame([(int(i), k) for k, i in enumerate(index)], f"__at long, {o} long")
        sdf = b.df.join(F.broadcast(want), b.df[B.POS] == want["__at"]).drop("__at", B.POS, B.ROW, B.BLOCK)  # as long as the caller's list
        return self._new(sdf, labels=_bare(self.labels), cols=_bare(self.cols), order=[(o, True)])

    def head(self, n: int = 5):
        return self._new(self._sdf.orderBy(*B.directed(self.order)).limit(max(0, n)))

    def tail(self, n: int = 5):
        back = [F.col(c).desc_nulls_first() if up else F.col(c).asc_nulls_first() for c, up in self.order]
        return self._new(self._sdf.orderBy(*back).limit(max(0, n)))

    def range(self, first: int, last: int):
        """Rows first..last-1."""
        b = self._positions()
        if not 0 <= first <= last <= b.size:
            raise IndexError(f"{first}..{last} of {b.size} rows")
        return self._placed(b, b.df.filter((F.col(B.POS) >= first) & (F.col(B.POS) < last)))

    def drop_row(self, index: int):
        b = self._positions()
        if not 0 <= index < b.size:
            raise IndexError(index)
        return self._placed(b, b.df.filter(F.col(B.POS) != index))

    def shuffle(self, seed: int = 0):
        """A permutation that depends on the seed, the order's keys and the values alone."""
        o = new_id()
        mixed = F.xxhash64(F.lit(seed), *(F.col(c) for c, _ in self.order), *(F.col(f.id) for f in self.fields))
        return self._new(self._sdf.withColumn(o, mixed), order=[(o, True), *self.order])

    def _passes(self, filters: Mapping[str, Predicate | Any]) -> list[Column]:
        """A null never passes."""
        tests = []
        for name, test in filters.items():
            f = self._named(name)
            if getattr(test, "_opaque", False):
                test = F.pandas_udf(test, "boolean")
            tests.append(self._valid(f) & test(F.col(f.raw or f.id)))
        return tests

    def _valid(self, f: Field) -> Column:
        """Not null, said of the source's column where there is one."""
        if not f.raw:
            return F.col(f.id).isNotNull()
        c = F.col(f.raw)
        if isinstance(self.kind(f), T.DoubleType):
            return c.isNotNull() & ~F.isnan(c) if self.options.nan_is_null else c.isNotNull()
        return c.isNotNull() & ~c.isin(self.options.nulls()) if self.options.nulls() else c.isNotNull()

    def _named(self, name: str) -> Field:
        return self.field(name)

    def filter(self, filters: Mapping[str, Predicate]):
        """Rows that pass all tests; a test takes a Column and gives one, or is ``opaque``."""
        return self._new(self._sdf.filter(B.all_of(self._passes(filters)))) if filters else self

    def filter_index(self, name: str, test: Predicate) -> list[int]:
        """Positions of the rows that pass, on the driver: as many as pass."""
        placed = self._placed(self._positions())
        at = placed.order[0][0]
        return [r[0] for r in placed._sdf.filter(B.all_of(placed._passes({name: test}))).select(at).orderBy(at).collect()]

    def _equals(self, name: str, value: Any) -> Column:
        f = self._named(name)
        kind, c = self.kind(f), F.col(f.raw or f.id)
        same = (isinstance(kind, T.StringType) and isinstance(value, str)) or (isinstance(kind, T.NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool))
        if same:
            return c == F.lit(value)
        return casts.to_text(c, kind) == F.lit(str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).lower() if isinstance(value, bool) else str(value))

    def filter_by_value(self, values: Mapping[str, Any]):
        """Rows whose values equal these, as text where the types differ."""
        return self._new(self._sdf.filter(B.all_of([self._valid(self._named(n)) & self._equals(n, v) for n, v in values.items()])))

    def where(self, filters: Mapping[str, Predicate], if_true: Any, if_false: Any, name: str = "") -> Series:
        """``if_true`` where all tests pass, else ``if_false``; null where a tested value is null. Values of two types become text."""
        tested = [self._named(n).id for n in filters]
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (if_true, if_false))
        if not isinstance(if_true, Column) and not isinstance(if_false, Column) and type(if_true) is not type(if_false):
            a, b = F.lit(str(if_true)), F.lit(str(if_false))
        f = Field(name, new_id())
        v = F.when(B.any_of([F.col(c).isNull() for c in tested]), None).when(B.all_of(self._passes(filters)), a).otherwise(b)
        return self._new(self._sdf.withColumn(f.id, v), cols=[f], level_names=(), name=name, kind=Series)

    def _subset(self, names: Sequence[str]) -> list[Field]:
        return [self._named(n) for n in names] or list(self.cols)

    def drop_null(self, *names: str):
        """Rows without a null in the columns named (all columns by default)."""
        return self._new(self._sdf.filter(B.all_of([self._valid(f) for f in self._subset(names)])))

    def is_null(self, *names: str):
        """Rows with a null in any of the columns named (all columns by default)."""
        return self._new(self._sdf.filter(B.any_of([F.col(f.id).isNull() for f in self._subset(names)])))

    def fill_null(self, how: Mapping[str, NullFiller]):
        fields = {self._named(n): h for n, h in how.items()}
        plain, out = {}, self
        for f, h in fields.items():
            if h.zero and not (h.forward or h.backward):
                plain[f.id] = F.coalesce(F.col(f.id), zero_of(self.kind(f)))
            elif not (h.forward or h.backward):
                plain[f.id] = F.coalesce(casts.to_float(F.col(f.id), self.kind(f)), F.lit(float(h.value)))
        for forward in (True, False):
            some = [f for f, h in fields.items() if (h.forward if forward else h.backward and not h.forward)]
            if some:
                b = out._positions()
                made = {f.id: new_id() for f in some}
                sdf = B.carried(b, made, forward)
                zeros = {n: F.coalesce(F.col(n), zero_of(self.kind(f))) for f, n in zip(some, made.values(), strict=True)}
                placed = out._placed(b, sdf.withColumns(zeros))
                swap = lambda x: Field(x.name, made.get(x.id, x.id))  # noqa: B023, E731
                out = placed._new(labels=[swap(x) for x in out.labels], cols=[swap(x) for x in out.cols])
        return out._values(plain) if plain else out

    def set_nulls(self, name: str, mask: Column | Sequence[bool]):
        """Null where the mask is true."""
        f = self._named(name)
        if isinstance(mask, Column):
            return self._values({f.id: F.when(~mask, F.col(f.id))})
        out = self.with_col("__mask", list(mask))
        m = out._column("__mask").id
        return out._values({f.id: F.when(~F.col(m), F.col(f.id))}).drop_col("__mask")

    # ---- order ----

    def sort(self, *by: Sorter | str):
        """A stable sort by several keys, each first cast; nulls last in both directions."""
        if not by:
            raise ValueError("sort needs a key")
        sdf, order = self._sdf, []
        for s in by:
            s = Sorter(s) if isinstance(s, str) else s
            f, o = self._named(s.name), new_id()
            sdf = sdf.withColumn(o, casts.cast(F.col(f.id), self.kind(f), s.kind, self.options))
            order.append((o, not s.descending))
        return self._new(sdf, order=[*order, *self.order])

    def append(self, other: Frame):
        """The rows of both, by position of their columns; columns of two types become text."""
        if len(self.labels) != len(other.labels) or len(self.cols) != len(other.cols):
            raise ValueError("both need as many labels and as many columns")
        ids = [new_id() for _ in self.fields]
        kinds = list(zip((self.kind(f) for f in self.fields), (other.kind(f) for f in other.fields), strict=True))

        o, keys = new_id(), [[new_id() for _ in x.order] for x in (self, other)]

        def side(frame: Frame, k: int) -> DataFrame:
            """Columns, the side, and the order keys of both sides, those of the other null: no row needs its position."""
            cols = [(casts.to_text(F.col(f.id), kinds[i][k]) if kinds[i][0] != kinds[i][1] else F.col(f.id)).alias(ids[i]) for i, f in enumerate(frame.fields)]
            own = [F.col(c).alias(x) for (c, _), x in zip(frame.order, keys[k], strict=True)]
            rest = [F.lit(None).cast((other, self)[k]._sdf.schema[c].dataType).alias(x) for (c, _), x in zip((other, self)[k].order, keys[1 - k], strict=True)]
            return frame._sdf.select(*cols, F.lit(k).alias(o), *own, *rest)

        sdf = side(self, 0).unionByName(side(other, 1))
        fields = [Field(f.name, i) for f, i in zip(self.fields, ids, strict=True)]
        order = [(o, True), *((x, up) for frame, own in ((self, keys[0]), (other, keys[1])) for (_, up), x in zip(frame.order, own, strict=True))]
        return self._new(sdf, labels=fields[: len(self.labels)], cols=fields[len(self.labels) :], order=order)

    # ---- functions of a caller ----

    def apply(self, functions: Mapping[str, Callable]):
        """New values from a function of the Column, or an ``opaque`` one of pandas Series (by batch, not by the whole column)."""
        made = {}
        for n, f in functions.items():
            c = self._named(n)
            if getattr(f, "_opaque", False):
                f = F.pandas_udf(f, f._kind or self.kind(c).simpleString())
            made[c.id] = f(F.col(c.id))
        return self._values(made)

    def set_rows(self, function: Callable, name: str, rows: Sequence[int]):
        """``function`` on the listed positions; the type stays."""
        f, b = self._named(name), self._positions()
        if any(not 0 <= i < b.size for i in rows):
            raise IndexError(f"positions must be in 0..{b.size - 1}")
        kind = self.kind(f)
        if getattr(function, "_opaque", False):
            function = F.pandas_udf(function, kind.simpleString())
        v = F.when(F.col(B.POS).isin(list(rows)), function(F.col(f.id))).otherwise(F.col(f.id)).cast(kind)
        return self._placed(b, b.df.withColumn(f.id, v))

    def resample(self, how: Mapping[str, Resampler]):
        return self._values({self._named(n).id: resampled(F.col(self._named(n).id), self.kind(self._named(n)), h) for n, h in how.items()})

    # ---- joins ----

    def _keys(self, other: Frame, left_on: Sequence[str] | None, right_on: Sequence[str] | None) -> tuple[list[Field], list[Field]]:
        if (left_on is None) != (right_on is None):
            raise ValueError("give keys of both sides or of none")
        if left_on is None:
            shared = [n for n in self.list_label_names() if n in other.list_label_names()]
            if not shared:
                raise ValueError("the sides share no label")
            return [self._label(n) for n in shared], [other._label(n) for n in shared]
        if len(left_on) != len(right_on):
            raise ValueError("as many keys on both sides")
        return [self._named(n) for n in left_on], [other._named(n) for n in right_on]

    def _looked_up(self, other: Frame, left: list[Field], right: list[Field], take: list[Field]) -> tuple[DataFrame, list[Field]]:
        """Every row of ``self`` with ``take`` of the first row of ``other`` that has its keys (null matches null); never more rows."""
        keys, cols = [], []
        for a, b in zip(left, right, strict=True):
            ka, kb = self.kind(a), other.kind(b)
            alike = ka == kb or (isinstance(ka, T.NumericType) and isinstance(kb, T.NumericType))
            keys.append((F.col(a.id) if alike else casts.to_text(F.col(a.id), ka), (F.col(b.id) if alike else casts.to_text(F.col(b.id), kb)).alias(new_id())))
        made = [Field(f.name, new_id()) for f in take]
        # the first row of each key, combined before any shuffle
        first = F.min_by(F.struct(*(F.col(f.id).alias(m.id) for f, m in zip(take, made, strict=True))), other._order_key())
        right_keys = [k for _, k in keys]
        names = [new_id() for _ in keys]
        got = other._sdf.groupBy(*(k.alias(n) for k, n in zip(right_keys, names, strict=True))).agg(first.alias("__first")).select(*names, "__first.*")
        sdf = self._sdf.join(got, B.all_of([a.eqNullSafe(F.col(n)) for (a, _), n in zip(keys, names, strict=True)]), "left").drop(*names)
        return sdf, made

    def _order_key(self) -> Column:
        """One column that sorts as the order does; only for orders that ascend or descend by numbers."""
        parts = []
        for c, up in self.order:
            kind = self._sdf.schema[c].dataType
            v = F.col(c)
            if not up:
                v = -v if isinstance(kind, T.NumericType) else -F.unix_micros(v.cast("timestamp")) if casts.is_time(kind) else None
                if v is None:
                    raise ValueError("sort by text, descending: call relabel() before an operator that looks for first rows")
            parts += [F.col(c).isNull(), v]
        return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))

    def _settled(self):
        """Self, or the same rows ordered by position where the order can't be one key."""
        if all(up or isinstance(self._sdf.schema[c].dataType, T.NumericType) or casts.is_time(self._sdf.schema[c].dataType) for c, up in self.order):
            return self
        b = self._positions()
        return self._placed(b)

    def lookup(self, other: Frame, how: str = "left", left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None):
        """The other side's columns beside this side's labels (``right``: the other way round); explicit keys are left out."""
        if how not in ("left", "right", "inner"):
            raise ValueError(f"how must be left, right or inner, not {how!r}")
        left, right = self._keys(other, left_on, right_on)
        a, b = (other, self) if how == "right" else (self, other)
        ka, kb = (right, left) if how == "right" else (left, right)
        b = b._settled()
        take = [f for f in b.cols if left_on is None or f not in kb]
        sdf, made = a._looked_up(b, ka, kb, take)
        out = a._new(sdf, cols=made, level_names=b.level_names, name=b.name, kind=Frame if len(made) != 1 or not isinstance(self, Series) else Series)
        return out.drop_null() if how == "inner" else out

    def merge(self, other: Frame, how: str = "left", left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, matched: bool = False) -> Frame:
        """Both sides' columns, first match only; repeated names get a suffix.

        ``inner`` keeps rows without any null; with ``matched`` it keeps the rows that have a match, whatever they hold.
        """
        if how not in ("left", "right", "inner"):
            raise ValueError(f"how must be left, right or inner, not {how!r}")
        left, right = self._keys(other, left_on, right_on)
        a, b = (other, self) if how == "right" else (self, other)
        ka, kb = (right, left) if how == "right" else (left, right)
        b = b._settled()
        take = [f for f in b.cols if left_on is None or f not in kb]
        mark = Field("__match", new_id())
        b = b._new(b._sdf.withColumn(mark.id, F.lit(True)))
        sdf, made = a._looked_up(b, ka, kb, [*take, mark])
        *made, hit = made
        if how == "inner" and matched:
            sdf = sdf.filter(F.col(hit.id))
        out = a._new(sdf, cols=[*a.cols, *made], level_names=(), kind=Frame)
        if how == "inner" and not matched:
            out = out.drop_null()
        return out.deduplicate_names()

    # ---- groups, reductions, shape ----

    def group_by(self, *names: str):
        from quillframe.operators.grouped import Grouped

        return Grouped(self, [self.field(n) for n in names] or list(self.labels))

    def _reduced(self, kind: str) -> Series:
        """One row for each column, labelled by its name: one aggregation, then a row for each column of its result."""
        from quillframe.operators.grouped import reducer

        made = {f: reducer(kind, F.col(f.id), self.kind(f), self) for f in self.cols}
        row = self._sdf.agg(*(c.alias(f.id) for f, c in made.items()))
        name, value, o = Field("*0", new_id()), Field(kind, new_id()), new_id()
        pairs = F.array(*(F.struct(F.lit(k).alias("o"), F.lit(f.name).alias("n"), F.col(f.id).alias("v")) for k, f in enumerate(made)))
        sdf = row.select(F.explode(pairs).alias("x")).select(F.col("x.n").alias(name.id), F.col("x.v").alias(value.id), F.col("x.o").alias(o))
        return self._new(sdf, labels=[name], cols=[value], order=[(o, True)], level_names=(), name=kind, kind=Series)

    def sum(self):
        return self._reduced("sum")

    def mean(self):
        return self._reduced("mean")

    def median(self):
        return self._reduced("median")

    def std(self):
        return self._reduced("stdDev")

    def count(self):
        return self._reduced("count")

    def nunique(self):
        return self._reduced("nunique")

    def min(self):
        return self._reduced("min")

    def max(self):
        return self._reduced("max")

    def reduce(self, name: str, function: Callable[[Column], Column]) -> Series:
        """A function of a Column to an aggregate, for each column."""
        row = self._sdf.agg(*(function(F.col(f.id)).alias(f.id) for f in self.cols))
        kinds = {row.schema[f.id].dataType.simpleString() for f in self.cols}
        label, value, o = Field("*0", new_id()), Field(name, new_id()), new_id()
        pairs = F.array(*(F.struct(F.lit(k).alias("o"), F.lit(f.name).alias("n"), (F.col(f.id) if len(kinds) == 1 else F.col(f.id).cast("string")).alias("v")) for k, f in enumerate(self.cols)))
        sdf = row.select(F.explode(pairs).alias("x")).select(F.col("x.n").alias(label.id), F.col("x.v").alias(value.id), F.col("x.o").alias(o))
        return self._new(sdf, labels=[label], cols=[value], order=[(o, True)], level_names=(), name=name, kind=Series)

    def transpose(self) -> Frame:
        from quillframe.operators.reshape import transpose

        return transpose(self)

    def promote_to_col_level(self, name: str) -> Frame:
        from quillframe.operators.reshape import promote

        return promote(self, name)

    def pivot_table(self, labels: str, columns: str, values: str, how: str = "sum") -> Frame:
        from quillframe.operators.reshape import pivot_table

        return pivot_table(self, labels, columns, values, how)

    def series(self) -> Series:
        if len(self.cols) != 1:
            raise ValueError(f"{len(self.cols)} columns, not 1")
        return self._new(name=self.cols[0].name, kind=Series)


class Series(Frame):
    """A frame of one value column. Where a name is asked for, ``""`` is the values."""

    @property
    def value(self) -> Field:
        return self.cols[0]

    def _named(self, name: str) -> Field:
        return self.value if name == "" else self.field(name)

    def set_name(self, name: str):
        return self._new(name=name, cols=[Field(name, self.value.id)])

    def frame(self) -> Frame:
        return self._new(kind=Frame)

    def type(self) -> T.DataType:
        return self.kind(self.value)

    # one value instead of a frame
    def _one(self, kind: str) -> Any:
        from quillframe.operators.grouped import reducer

        return self._sdf.agg(reducer(kind, F.col(self.value.id), self.type(), self).alias("v")).first()[0]

    def sum(self):
        return self._one("sum")

    def mean(self):
        return self._one("mean")

    def median(self):
        return self._one("median")

    def std(self):
        return self._one("stdDev")

    def count(self) -> int:
        return self._one("count") or 0

    def nunique(self) -> int:
        return self._one("nunique") or 0

    def min(self):
        return self._one("min")

    def max(self):
        return self._one("max")

    def earliest(self):
        return self._one("earliest")

    def latest(self):
        return self._one("latest")

    def reduce(self, function: Callable[[Column], Column]) -> Any:
        return self._sdf.agg(function(F.col(self.value.id)).alias("v")).first()[0]

    def _collected(self, c: Column) -> list:
        return [r[0] for r in self._sdf.orderBy(*B.directed(self.order)).select(c).collect()]

    def get_values(self) -> list:
        return self._collected(F.col(self.value.id))

    def get_values_as_float(self) -> list:
        return self._collected(casts.to_float(F.col(self.value.id), self.type()))

    def get_values_as_string(self) -> list:
        return self._collected(casts.to_text(F.col(self.value.id), self.type()))

    def get_values_as_time(self) -> list:
        return self._collected(casts.to_time(F.col(self.value.id), self.type(), self.options))

    def get_nulls(self) -> list[bool]:
        return self._collected(F.col(self.value.id).isNull())

    def with_values(self, value: Any) -> Series:
        return self._with(self.value.id, value, False)

    def filter(self, filters: Mapping[str, Predicate] | Predicate):
        return super().filter(filters if isinstance(filters, Mapping) else {"": filters})

    def fill_null(self, how: NullFiller | Mapping[str, NullFiller]):
        return super().fill_null(how if isinstance(how, Mapping) else {"": how})

    def apply(self, function: Callable | Mapping[str, Callable]):
        return super().apply(function if isinstance(function, Mapping) else {"": function})

    def set_rows(self, function: Callable, rows: Sequence[int]):  # noqa: D102
        return super().set_rows(function, "", rows)

    def resample(self, how: Resampler | Mapping[str, Resampler]):
        return super().resample(how if isinstance(how, Mapping) else {"": how})

    def sort(self, *by: Sorter | str):
        """By number, ascending, without keys."""
        return super().sort(*(by or (Sorter("", casts.FLOAT),)))

    # arithmetic over labels
    def _math(self, other: Series, ignore_nulls: bool, f: Callable[[Column, Column], Column]) -> Series:
        left, right = self._keys(other, None, None)
        sdf, made = self._looked_up(other._settled(), left, right, [other.value])
        a, b = casts.to_float(F.col(self.value.id), self.type()), casts.to_float(F.col(made[0].id), other.type())
        v = f(a, b)
        v = F.when(a.isNull() & b.isNull(), None).when(a.isNull(), b if ignore_nulls else None).when(b.isNull(), a if ignore_nulls else None).otherwise(v)
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        g = Field(self.value.name, new_id())
        return self._new(sdf.withColumn(g.id, v), cols=[g])

    def add(self, other: Series, ignore_nulls: bool = False) -> Series:
        """A null operand makes null; with ``ignore_nulls`` the other operand, unchanged, takes its place (so in all four)."""
        return self._math(other, ignore_nulls, lambda a, b: a + b)

    def subtract(self, other: Series, ignore_nulls: bool = False) -> Series:
        return self._math(other, ignore_nulls, lambda a, b: a - b)

    def multiply(self, other: Series, ignore_nulls: bool = False) -> Series:
        return self._math(other, ignore_nulls, lambda a, b: a * b)

    def divide(self, other: Series, ignore_nulls: bool = False) -> Series:
        return self._math(other, ignore_nulls, lambda a, b: F.try_divide(a, b))

    # over the order
    def _number(self) -> Column:
        return casts.to_float(F.col(self.value.id), self.type())

    def _valued(self, sdf: DataFrame, id_: str, name: str | None = None, **more) -> Series:
        return self._new(sdf, cols=[Field(name or self.value.name, id_)], **more)

    def cumsum(self) -> Series:
        b, v = self._positions(), new_id()
        out = self._placed(b, B.running_sum(b, self._number(), v))
        return out._new(cols=[Field(self.value.name, v)])

    def shift(self, n: int) -> Series:
        b, v = self._positions(), new_id()
        out = self._placed(b, B.shifted(b, n, {self.value.id: v}))
        return out._new(cols=[Field(self.value.name, v)])

    def _ranked(self) -> tuple[DataFrame, str, str, int]:
        v, rank, below = new_id(), new_id(), new_id()
        sdf, n = B.dense_ranks(self._sdf.withColumn(v, self._number()), v, rank, below)
        return sdf, rank, below, n

    def rank(self) -> Series:
        """Dense, ascending, from 1; null for null."""
        sdf, rank, _, _ = self._ranked()
        return self._valued(sdf, rank)

    def percentile(self) -> Series:
        """The share of values strictly below; null for null."""
        sdf, _, below, n = self._ranked()
        v = new_id()
        return self._valued(sdf.withColumn(v, F.col(below) / F.lit(float(max(1, n)))), v)

    def bin(self, edges: Sequence[float], and_less: bool = False, and_more: bool = False, names: Sequence[str] | None = None) -> Series:
        v = new_id()
        return self._valued(self._sdf.withColumn(v, binned(self._number(), edges, and_less, and_more, names)), v)

    def percentile_bin(self, edges: Sequence[float], and_less: bool = False, and_more: bool = False, names: Sequence[str] | None = None) -> Series:
        if min(edges) < 0 or max(edges) > 1:
            raise ValueError("edges must be in 0..1")
        p, v = self.percentile(), new_id()
        return p._valued(p._sdf.withColumn(v, binned(F.col(p.value.id), edges, and_less, and_more, names, left_closed=True)), v)

    def rolling_n(self, n: int):
        from quillframe.operators.grouped import RollingRows

        return RollingRows(self, n)

    def rolling_duration(self, d: timedelta):
        from quillframe.operators.grouped import RollingTime

        return RollingTime(self, d)

    def value_counts(self) -> dict[str, int]:
        return {r[0]: r[1] for r in self.value_counts_frame().collect()}

    def value_counts_frame(self) -> DataFrame:
        v = casts.to_text(F.col(self.value.id), self.type())
        return self._sdf.filter(F.col(self.value.id).isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("count"))

    def unique(self, labels: bool = False, drop_null: bool = False) -> Series:
        """The first row of each value (of each value and label, if ``labels``); null is a value unless dropped."""
        s = self._settled()
        keys = [f.id for f in (s.fields if labels else [s.value])]
        sdf = s._sdf.filter(F.col(s.value.id).isNotNull()) if drop_null else s._sdf
        first = sdf.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*s._sdf.columns), s._order_key()).alias("r"))
        return s._new(first.select("r.*"))


class Mutator:
    """Operators that replace what it holds; nothing is changed in place. ``result`` is the frame so far."""

    def __init__(self, frame: Frame):
        self.result = frame

    def __getattr__(self, name: str):
        f = getattr(self.result, name)

        def call(*a, **b):
            out = f(*a, **b)
            if isinstance(out, Frame):
                self.result = out
                return self
            return out

        return call


class Attempt:
    """Operators of a frame (or its groups) up to the first error, which is kept: later ones are left out. ``err`` is it, or None; ``result`` what came before."""

    def __init__(self, held: Any, error: Exception | None = None):
        self.result, self._error = held, error

    def err(self) -> Exception | None:
        return self._error

    def __getattr__(self, name: str):
        def call(*a, **b):
            if self._error is not None:
                return self
            try:
                return Attempt(getattr(self.result, name)(*a, **b))
            except Exception as error:  # whatever it is, it is kept
                return Attempt(self.result, error)

        return call


def concat_series(*series: Series) -> Frame:
    """Side by side, by merging on shared labels from the left."""
    out: Frame = series[0].frame()
    for s in series[1:]:
        out = out.merge(s.frame())
    return out


def label_product(*levels: Frame) -> Frame:
    """Every combination of the levels' rows, the first varying slowest, as labels beside the last column: for levels that are tables."""
    out, order, labels = levels[0]._sdf, list(levels[0].order), list(_bare(levels[0].cols))
    for x in levels[1:]:
        out = out.crossJoin(x._sdf)  # the product is what is asked for
        order, labels = [*order, *x.order], [*labels, *_bare(x.cols)]
    return Frame(out, labels[:-1] or labels, labels[-1:], order, options=levels[0].options)


def make_multi_level_labels(labels: Sequence[Sequence]) -> list[list]:
    """The product of local lists, the first varying slowest, one list for each level; ``label_product`` is that of frames."""
    return [list(x) for x in zip(*itertools.product(*labels), strict=True)]
