"""Groups of rows by key: reductions, reductions broadcast back to the rows, group filters, functions within groups, rolling windows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from quillframe.functions import casts
from quillframe.operators import blocks as B
from quillframe.operators.frame import Field, Frame, Series, new_id

NUMBERS = ("sum", "mean", "median", "stdDev", "min", "max")
#: Rows of a group that an iterator of groups brings to the driver at most.
LOCAL = 1 << 12
KINDS = (*NUMBERS, "count", "nunique", "earliest", "latest", "first", "last")


def reducer(kind: str, c: Column, of: T.DataType, frame: Frame) -> Column:
    """An aggregate. A group without a value is null, and so is a count of none."""
    if kind in NUMBERS:
        v = casts.to_float(c, of)
        return {"sum": F.sum, "mean": F.avg, "median": F.median, "stdDev": F.stddev_pop, "min": F.min, "max": F.max}[kind](v)
    if kind == "count":
        return F.nullif(F.count(c), F.lit(0).cast("long"))
    if kind == "nunique":
        return F.nullif(F.count_distinct(c), F.lit(0).cast("long"))
    if kind in ("earliest", "latest"):
        return (F.min if kind == "earliest" else F.max)(casts.to_time(c, of, frame.options))
    if kind in ("first", "last"):
        return (F.min_by if kind == "first" else F.max_by)(c, frame._order_key())
    raise ValueError(f"unknown reduction {kind!r}; one of {', '.join(KINDS)}")


class Grouped:
    def __init__(self, frame: Frame, keys: Sequence[Field], having: Sequence[Callable[[Column], Column]] = (), aligned: bool = False):
        self.frame, self.keys, self.having, self.aligned = frame._settled(), tuple(keys), tuple(having), aligned

    def _cols(self, names: Sequence[str]) -> list[Field]:
        values = [f for f in self.frame.cols if f not in self.keys]
        if not names:
            return values
        for n in names:
            if not any(n in (f.name, f.id) for f in values):
                raise KeyError(f"no column {n!r} in the groups")
        return [next(f for f in values if n in (f.name, f.id)) for n in names]

    def _ids(self) -> list[str]:
        return [f.id for f in self.keys]

    def _groups(self, aggregates: dict[str, Column]) -> DataFrame:
        """One row for each group: keys, aggregates, ``__first`` (where it first appears)."""
        passes = B.all_of([test(F.col("__rows")) for test in self.having])
        out = self.frame._sdf.groupBy(*self._ids()).agg(*(c.alias(n) for n, c in aggregates.items()), F.min(self.frame._order_key()).alias("__first"), F.count("*").alias("__rows"))
        return out.filter(passes).drop("__rows") if self.having else out.drop("__rows")

    def _named(self, kind: str, f: Field) -> Field:
        return Field(f"{kind}_{f.name}" if f.name else kind, new_id())

    def _onto(self, groups: DataFrame) -> DataFrame:
        """Rows with the columns of their group; rows without one have nulls."""
        names = {k: new_id() for k in self._ids()}
        right = groups.withColumnsRenamed(names)
        return self.frame._sdf.join(right, B.all_of([F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]), "left").drop(*names.values())

    def _made(self, kind: str, made: dict[Field, Column]) -> Frame:
        return self._of_groups(kind, self._groups({f.id: c for f, c in made.items()}), list(made))

    def _of_groups(self, kind: str, groups: DataFrame, made: Sequence[Field]) -> Frame:
        name = f"{kind}_{self.frame.name}" if self.frame.name else kind
        shape = Series if isinstance(self.frame, Series) or len(made) == 1 and self.aligned else Frame
        if self.aligned:
            return self.frame._new(self._onto(groups.drop("__first")), cols=list(made), name=name, level_names=(), kind=shape)
        o = new_id()
        return self.frame._new(groups.withColumnRenamed("__first", o), labels=self.keys, cols=list(made), order=[(o, True)], name=name, level_names=(), kind=shape)

    def agg(self, kind: str, *names: str) -> Frame:
        """``kind`` of each column (all value columns by default), named ``kind_column``."""
        return self._made(kind, {self._named(kind, f): reducer(kind, F.col(f.id), self.frame.kind(f), self.frame) for f in self._cols(names)})

    def sum(self, *names: str) -> Frame:
        return self.agg("sum", *names)

    def mean(self, *names: str) -> Frame:
        return self.agg("mean", *names)

    def median(self, *names: str, spread: bool = False) -> Frame:
        """Exact medians. The plain form holds a group's distinct values in one buffer; ``spread`` selects by rank over sorted blocks instead, for
        groups whose values outgrow a task."""
        return self._spread_median(names) if spread else self.agg("median", *names)

    def _spread_median(self, names: Sequence[str]) -> Frame:
        groups, made = self._groups({}), []
        for f in self._cols(names):
            m = self._named("median", f)
            ids = {k: new_id() for k in self._ids()}
            per = self.frame._sdf.select(*(F.col(k).alias(i) for k, i in ids.items()), casts.to_float(F.col(f.id), self.frame.kind(f)).alias("__x"))
            per = per.filter(F.col("__x").isNotNull()).groupBy(*ids.values(), "__x").agg(F.count("*").cast("double").alias("__n"))
            run = B.running_sum(B.blocks_of(per, [*((i, True) for i in ids.values()), ("__x", True)]), F.col("__n"), "__upto")
            starts = run.groupBy(*ids.values()).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"), F.sum("__n").alias("__all"))
            names_ = {i: new_id() for i in ids.values()}
            run = run.join(starts.withColumnsRenamed(names_), B.all_of([F.col(i).eqNullSafe(F.col(x)) for i, x in names_.items()]))
            beyond = lambda k: F.min(F.when(F.col("__upto") - F.col("__start") > F.floor(k), F.col("__x")))
            got = run.groupBy(*ids.values()).agg(((beyond((F.col("__all") - 1) / 2) + beyond(F.col("__all") / 2)) / 2).alias(m.id))
            groups = groups.join(got, B.all_of([F.col(k).eqNullSafe(F.col(i)) for k, i in ids.items()]), "left").drop(*ids.values())
            made.append(m)
        return self._of_groups("median", groups, made)

    def std(self, *names: str) -> Frame:
        return self.agg("stdDev", *names)

    def min(self, *names: str) -> Frame:
        return self.agg("min", *names)

    def max(self, *names: str) -> Frame:
        return self.agg("max", *names)

    def count(self, *names: str) -> Frame:
        return self.agg("count", *names)

    def nunique(self, *names: str) -> Frame:
        return self.agg("nunique", *names)

    def earliest(self, *names: str) -> Frame:
        return self.agg("earliest", *names)

    def latest(self, *names: str) -> Frame:
        return self.agg("latest", *names)

    def first(self, *names: str) -> Frame:
        return self.agg("first", *names)

    def last(self, *names: str) -> Frame:
        return self.agg("last", *names)

    def nth(self, n: int, *names: str) -> Frame:
        """The n-th row of each group (from the end if negative), null where there's none; rows with nulls count.

        The row number is limited before the shuffle, so a large group sends only its first rows on.
        """
        cols, k = self._cols(names), n + 1 if n >= 0 else -n
        order = B.directed(self.frame.order) if n >= 0 else [F.col(c).desc_nulls_first() if up else F.col(c).asc_nulls_first() for c, up in self.frame.order]
        made = [self._named("nth", f) for f in cols]
        w = Window.partitionBy(*self._ids()).orderBy(*order)
        top = self.frame._sdf.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).filter(F.col("__n") == k)
        keys = {i: new_id() for i in self._ids()}
        top = top.select(*(F.col(i).alias(x) for i, x in keys.items()), *(F.col(f.id).alias(m.id) for f, m in zip(cols, made, strict=True)))
        groups = self._groups({}).join(top, B.all_of([F.col(i).eqNullSafe(F.col(x)) for i, x in keys.items()]), "left").drop(*keys.values())
        if self.aligned:
            return self.frame._new(self._onto(groups.drop("__first")), cols=made, level_names=())
        o = new_id()
        shape = Series if isinstance(self.frame, Series) else Frame
        return self.frame._new(groups.withColumnRenamed("__first", o), labels=self.keys, cols=made, order=[(o, True)], name=f"nth_{self.frame.name}" if self.frame.name else "nth", level_names=(), kind=shape)

    def reduce(self, name: str, function: Callable, *names: str) -> Frame:
        """``function``: a Column to an aggregate, or an ``opaque`` one of a pandas Series to a value (a group must fit a task)."""
        if getattr(function, "_opaque", False):
            from pyspark.sql.functions import pandas_udf

            kind, plain = function._kind or "double", function

            def call(v: pd.Series) -> Any:
                return plain(v)

            call.__annotations__ = {"v": pd.Series, "return": float}
            made = {self._named(name, f): pandas_udf(call, kind, F.PandasUDFType.GROUPED_AGG)(F.col(f.id)) for f in self._cols(names)}
            first = self._groups({})  # a pandas aggregate can't share an aggregation with others
            got = self.frame._sdf.groupBy(*self._ids()).agg(*(c.alias(f.id) for f, c in made.items()))
            keys = {i: new_id() for i in self._ids()}
            groups = first.join(got.withColumnsRenamed(keys), B.all_of([F.col(i).eqNullSafe(F.col(x)) for i, x in keys.items()])).drop(*keys.values())
            o = new_id()
            return self.frame._new(groups.withColumnRenamed("__first", o), labels=self.keys, cols=list(made), order=[(o, True)], level_names=())
        return self._made(name, {self._named(name, f): function(F.col(f.id)) for f in self._cols(names)})

    def align(self) -> Grouped:
        """Reductions go to every row of their group: an aggregation joined back, so a large group is no single task."""
        return type(self)(self.frame, self.keys, self.having, True)

    def having_count(self, test: Callable[[Column], Column]) -> Grouped:
        """Groups whose number of rows passes."""
        return type(self)(self.frame, self.keys, [*self.having, test], self.aligned)

    def _kept(self) -> DataFrame:
        if not self.having:
            return self.frame._sdf
        mark = new_id()
        return self._onto(self._groups({mark: F.lit(True)}).drop("__first")).filter(F.col(mark)).drop(mark)

    def apply(self, function: Callable, *names: str, of_group: Mapping[str, Callable[[Column], Column]] | None = None) -> Grouped:
        """New values within groups. ``function``: (Column, window of the group) to a Column, or an ``opaque`` one of a group's pandas Series.

        A window puts a group into one task. With ``of_group``, aggregates by name, ``function`` takes (Column, their values by name): an
        aggregation joined back, in which no group is one task.
        """
        cols = self._cols(names)
        if of_group is not None:
            made = {f.id: {n: new_id() for n in of_group} for f in cols}
            groups = self._groups({i: of_group[n](F.col(c)) for c, by in made.items() for n, i in by.items()})
            sdf = self._onto(groups.drop("__first").withColumn("__in", F.lit(True))).filter("__in").drop("__in")
            sdf = sdf.withColumns({c: function(F.col(c), {n: F.col(i) for n, i in by.items()}) for c, by in made.items()})
            return type(self)(self.frame._new(sdf.drop(*(i for by in made.values() for i in by.values())), cols=[Field(f.name, f.id) if f in cols else f for f in self.frame.cols]), self.keys, self.having, self.aligned)
        if getattr(function, "_opaque", False):
            kinds = {f.id: function._kind or self.frame.kind(f).simpleString() for f in cols}
            fields = [f"`{c.name}` {kinds.get(c.name, c.dataType.simpleString())}" for c in self._kept().schema]
            order, ids = [c for c, _ in self.frame.order], [f.id for f in cols]
            ups = [up for _, up in self.frame.order]

            def run(p: pd.DataFrame) -> pd.DataFrame:
                p = p.sort_values(order, ascending=ups, na_position="last", kind="stable").reset_index(drop=True)
                for i in ids:
                    p[i] = function(p[i])
                return p

            sdf = self._kept().groupBy(*self._ids()).applyInPandas(run, ", ".join(fields))
        else:
            w = Window.partitionBy(*self._ids())
            sdf = self._kept().withColumns({f.id: function(F.col(f.id), w) for f in cols})
        return type(self)(self.frame._new(sdf), self.keys, self.having, self.aligned)

    def frame_(self) -> Frame:
        """The rows, group after group (in their own order if aligned); keys are labels."""
        cols = self._cols(())
        if self.aligned:
            return self.frame._new(self._kept(), labels=self.keys, cols=cols)
        o = new_id()
        sdf = self._onto(self._groups({}).withColumnRenamed("__first", o)).filter(F.col(o).isNotNull())
        return self.frame._new(sdf, labels=self.keys, cols=cols, order=[(o, True), *self.frame.order])

    to_frame = frame_

    def _text(self) -> Column:
        return F.concat_ws(self.frame.options.separator, *(F.coalesce(casts.to_text(F.col(f.id), self.frame.kind(f)), F.lit("(null)")) for f in self.keys))

    def get_group(self, key: Any) -> Frame:
        """Rows of one key: a tuple of its parts, typed, or their texts joined by the separator. A text that two keys share is an error."""
        if isinstance(key, tuple):
            if len(key) != len(self.keys):
                raise ValueError(f"{len(key)} parts for {len(self.keys)} keys")
            test = B.all_of([F.col(f.id).eqNullSafe(F.lit(x).cast(self.frame.kind(f))) for f, x in zip(self.keys, key, strict=True)])
        else:
            test = self._text() == key
            if len(self.keys) > 1 and len(self.frame._sdf.filter(test).select(*self._ids()).distinct().limit(2).collect()) > 1:
                raise ValueError(f"several keys read {key!r}: give a tuple")
        return self.frame._new(self._kept().filter(test), labels=self.keys, cols=self._cols(()))

    def col(self, name: str) -> Grouped:
        f = self._cols([name])[0]
        return Grouped(self.frame._new(cols=[f], level_names=(), name=f.name, kind=Series), self.keys, self.having, self.aligned)

    def list_groups(self) -> list[str]:
        """Keys as texts in order of first appearance, all on the driver."""
        return [r[0] for r in self._groups({}).select(self._text().alias("k"), "__first").orderBy("__first").collect()]

    def __len__(self) -> int:
        return self._groups({}).count()

    def get_labels(self) -> list[list]:
        got = self._groups({}).orderBy("__first").select(*self._ids()).collect()
        return [[r[k] for r in got] for k in range(len(self.keys))]

    def __iter__(self) -> Iterator[Frame]:
        """Group after group by first appearance. Groups of at most ``LOCAL`` rows come in one pass over the sorted rows of all of these, each on the
        driver while it is the current one; a larger one is a filter of the rows, which stay where they are."""
        g = self.frame_()
        ids, n = [f.id for f in g.fields], len(g.labels)
        names, o, rows = [new_id() for _ in ids], new_id(), new_id()
        kinds = ", ".join([*(f"{i} {g._sdf.schema[c].dataType.simpleString()}" for i, c in zip(names, ids, strict=True)), f"{o} long"])
        fields = [Field(f.name, i) for f, i in zip(g.fields, names, strict=True)]
        keys = [(c, True) for c in self._ids()]
        groups = self._groups({rows: F.count("*")})
        first = keys if self.aligned else [("__first", True), *keys]
        # rows of one group follow each other: their first appearance leads the order, and keys tell groups apart
        order = keys + list(g.order) if self.aligned else [g.order[0], *keys, *g.order[1:]]
        other = {k: new_id() for k in self._ids()}
        same = B.all_of([F.col(k).eqNullSafe(F.col(x)) for k, x in other.items()])
        small = groups.filter(F.col(rows) <= LOCAL).select(*(F.col(k).alias(x) for k, x in other.items()))
        local = None
        for r in groups.orderBy(*B.directed(first)).select(*self._ids(), rows).toLocalIterator():
            if r[rows] > LOCAL:
                key = g.spark.createDataFrame([tuple(r[k] for k in self._ids())], T.StructType([T.StructField(x, g._sdf.schema[k].dataType) for k, x in other.items()]))
                yield g._new(g._sdf.join(F.broadcast(key), same, "left_semi"), order=order)
                continue
            if local is None:
                local = g._sdf.join(small, same, "left_semi").orderBy(*B.directed(order)).select(*ids).toLocalIterator()
            own = [(*x, k) for k, x in enumerate(itertools.islice(local, r[rows]))]
            yield g._new(g.spark.createDataFrame(own, kinds), labels=fields[:n], cols=fields[n:], order=[(o, True)])

    def __str__(self) -> str:
        return str(self.frame_())


def _windowed(kind: str, c: Column, of: T.DataType, frame: Frame) -> Column | tuple[Column, Callable[[Column], Column]]:
    """The aggregate of a window frame, and what remains to be done to its result."""
    same = lambda x: x
    if kind == "median":
        def middle(v: Column) -> Column:
            v, n = F.array_sort(v), F.size(v)
            return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)

        return F.collect_list(casts.to_float(c, of)), middle
    if kind == "nunique":
        return F.collect_set(c), lambda v: F.nullif(F.size(v).cast("long"), F.lit(0).cast("long"))
    if kind == "count":
        return F.count(c), lambda v: F.nullif(v, F.lit(0).cast("long"))
    if kind == "first":
        return F.first(c), same
    if kind == "last":
        return F.last(c), same
    return reducer(kind, c, of, frame), same


def _nth(c: Column, n: int, w: WindowSpec) -> Column:
    """The n-th row of a window, from its end if negative; nulls are rows."""
    return F.nth_value(c, n + 1).over(w) if n >= 0 else F.get(F.reverse(F.collect_list(F.struct(c.alias("v"))).over(w)), F.lit(-n - 1))["v"]


def _nulls_or(test: Column | None, c: Column) -> Column:
    return c if test is None else F.when(test, c)


class _Rolling:
    """Windows over the rows of a series as groups: each row with some of those after it. A row has its window's result; where windows are filtered
    or incomplete, that of the last window left that holds the row, and null if there's none."""

    def __init__(self, series: Series, value: Field | None = None, having: Sequence[Callable[[Column], Column]] = ()):
        self.series, self.of, self.having = series, value or series.value, tuple(having)

    def _like(self, series: Series, value: Field, having: Sequence[Callable[[Column], Column]]) -> _Rolling:
        raise NotImplementedError

    def _results(self, name: str, aggregate: Callable[[WindowSpec], Column], then: Callable[[Column, Column], Column]) -> Series:
        """``then``: what remains to be done to the result; it gets the row's place in its window, too."""
        raise NotImplementedError

    def _named(self, name: str) -> str:
        return f"{name}_{self.of.name}" if self.of.name else name

    def agg(self, kind: str) -> Series:
        a, then = _windowed(kind, F.col(self.of.id), self.series.kind(self.of), self.series)
        return self._results(self._named(kind), a.over, lambda v, _: then(v))

    def nth(self, n: int) -> Series:
        """The n-th row of each window (from its end if negative), null where there's none."""
        return self._results(self._named("nth"), lambda w: _nth(F.col(self.of.id), n, w), lambda v, _: v)

    def reduce(self, name: str, function: Callable) -> Series:
        """``function``: (Column, window) to a Column, or an ``opaque`` one of a pandas Series of a window's values to a value."""
        if getattr(function, "_opaque", False):
            kind = function._kind or "double"
            call = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else function(pd.Series(list(x)))), kind)
            return self._results(self._named(name), lambda w: self._list(w), lambda v, _: call(v))
        return self._results(self._named(name), lambda w: function(F.col(self.of.id), w), lambda v, _: v)

    def _list(self, w: WindowSpec) -> Column:
        """All values of a window, nulls included."""
        return F.transform(F.collect_list(F.struct(F.col(self.of.id).alias("v"))).over(w), lambda x: x["v"])

    def apply(self, function: Callable) -> _Rolling:
        """New values within windows, as many as there were: each row takes its own from its window. ``function``: an array Column to one, or an
        ``opaque`` one of pandas Series."""
        kind = self.series.kind(self.of).simpleString()
        if getattr(function, "_opaque", False):
            plain = function
            function = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else list(plain(pd.Series(list(x))))), f"array<{function._kind or kind}>")
        out = self._results(self.of.name, lambda w: self._list(w), lambda v, place: F.get(function(v), place.cast("int")))
        # windows stay those of the series' own values
        kept = out._new(cols=[self.series.value], name=self.series.name)
        return self._like(kept, out.value, self.having)

    def having_count(self, test: Callable[[Column], Column]) -> _Rolling:
        """Windows whose number of rows passes."""
        return self._like(self.series, self.of, [*self.having, test])

    def _passes(self, rows: Column) -> Column | None:
        return B.all_of([test(rows) for test in self.having]) if self.having else None

    def __iter__(self) -> Iterator[list]:
        """The values of every window, row by row, on the driver."""
        got = self._windows()
        for r in got._sdf.orderBy(*B.directed(got.order)).select(got.value.id).toLocalIterator():
            if r[0] is not None:
                yield list(r[0])

    def _windows(self) -> Series:
        raise NotImplementedError

    def __len__(self) -> int:
        got = self._windows()
        return got._sdf.filter(F.col(got.value.id).isNotNull()).count()

    def __getattr__(self, name: str) -> Callable[[], Series]:
        kind = {"std": "stdDev"}.get(name, name)
        if kind not in KINDS:
            raise AttributeError(name)
        return lambda: self.agg(kind)


class RollingRows(_Rolling):
    """Each row with the n - 1 after it. Rows at the end, whose window is cut off, have the last complete window's result."""

    def __init__(self, series: Series, n: int, value: Field | None = None, having: Sequence[Callable[[Column], Column]] = ()):
        if n < 1:
            raise ValueError("a window has one row or more")
        super().__init__(series, value, having)
        self.n = n

    def _like(self, series: Series, value: Field, having: Sequence[Callable[[Column], Column]]) -> RollingRows:
        return RollingRows(series, self.n, value, having)

    def _rows(self) -> Series:
        """The series with what windows are over as a column of its blocks."""
        return self.series if self.of.id == self.series.value.id else self.series._new(cols=[self.series.value, self.of])

    def _results(self, name: str, aggregate: Callable[[WindowSpec], Column], then: Callable[[Column, Column], Column]) -> Series:
        s, v = self._rows(), new_id()
        b = s._positions()
        place = F.col(B.POS) - F.least(F.col(B.POS), F.lit(b.size - self.n))
        df = B.forward_rows(b, self.n, {v: aggregate})
        if self.n <= b.size:
            df = df.withColumn(v, _nulls_or(self._passes(F.lit(self.n)), then(F.col(v), place)))
        return s._placed(b, df)._new(cols=[Field(name, v)], name=name, kind=Series)

    def _windows(self) -> Series:
        s, v = self._rows(), new_id()
        b = s._positions()
        df = B.forward_rows(b, self.n, {v: self._list})
        whole = (F.col(B.POS) <= b.size - self.n) & (self._passes(F.lit(self.n)) if self.having else F.lit(True))
        return s._placed(b, df.withColumn(v, F.when(whole, F.col(v))))._new(cols=[Field("windows", v)], kind=Series)


def _from_places(c: Column, whole: str, size: Column, element: Callable[[bool, Any], Column]) -> Column | None:
    """``c`` without the array column ``whole``: its size and its elements (``get``, of it or of it reversed) are put in their place.

    ``element`` gets whether the index, a number or a Column, counts from the end. None if ``c`` needs the array itself.
    """
    if not hasattr(c, "_jc"):
        return None
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_seq

    sc = SparkContext._active_spark_context
    column = lambda n: Classic(sc._jvm.org.apache.spark.sql.Column(n))
    kind = lambda n: n.getClass().getSimpleName()

    def turned(n: Any) -> bool | None:
        """Whether it is the array in its order (False) or reversed; None if it is neither."""
        if kind(n) == "UnresolvedAttribute":
            return False if n.nameParts().mkString(".") == whole else None
        if kind(n) == "UnresolvedFunction" and n.functionName() == "reverse":
            got = turned(n.arguments().apply(0))
            return None if got is None else not got
        return None

    def number(n: Any) -> int | None:
        while kind(n) == "Cast":
            n = n.child()
        return n.value() if kind(n) == "Literal" and type(n.value()) is int else None

    def put(n: Any) -> Any:
        if kind(n) == "Literal" or kind(n) == "UnresolvedAttribute" and turned(n) is None:
            return n
        if kind(n) in ("Cast", "Alias"):
            child = put(n.child())
            rest = (n.dataType(), n.evalMode()) if kind(n) == "Cast" else (n.name(), n.metadata())
            return None if child is None else n.copy(child, *rest, n.origin())
        if kind(n) != "UnresolvedFunction":
            return None
        args = [n.arguments().apply(k) for k in range(n.arguments().size())]
        if args and (back := turned(args[0])) is not None:
            if n.functionName() == "size":
                return size._jc.node()
            at = put(args[1]) if n.functionName() == "get" else None
            if at is None:
                return None
            k = number(at)
            return element(back, column(at) if k is None else k)._jc.node()
        args = [put(x) for x in args]
        if any(x is None for x in args):
            return None
        return n.copy(n.functionName(), _to_seq(sc, args), n.isDistinct(), n.isUserDefinedFunction(), n.isInternal(), n.origin())

    got = put(c._jc.node())
    return None if got is None else column(got)


class RollingTime(_Rolling):
    """Each timestamp with those after it that are less than the duration later; rows must ascend by time. A window is two positions (``blocks.forward_ranges``),
    and results that need its size, its ends or single elements take them by position. Only functions of all of a window's values get them as an
    array: a row is then copied to its own bucket of the duration and its neighbours, so a window never leaves a bucket, and all windows are written out."""

    def __init__(self, series: Series, d: timedelta, value: Field | None = None, having: Sequence[Callable[[Column], Column]] = ()):
        if d < timedelta(0):
            raise ValueError("a duration isn't negative")
        super().__init__(series, value, having)
        self.d = d

    def _like(self, series: Series, value: Field, having: Sequence[Callable[[Column], Column]]) -> RollingTime:
        return RollingTime(series, self.d, value, having)

    def _spread(self, around: Sequence[int]) -> tuple[DataFrame, DataFrame]:
        """Rows with a time, copied to buckets of the duration, and those without one."""
        s = self.series
        at = F.unix_micros(casts.to_time(F.col(s.value.id), s.type(), s.options).cast("timestamp"))
        df = s._sdf.withColumn("__us", at).withColumn("__key", s._settled()._order_key())
        timed = df.filter(F.col("__us").isNotNull()).withColumn("__own", F.floor(F.col("__us") / self._step()))
        spread = timed.withColumn("__bucket", F.explode(F.array(*(F.col("__own") - k for k in around))))
        # of equal timestamps only those at or after the row in order are in its window
        peers = Window.partitionBy("__bucket", "__us").orderBy("__key")
        return spread.withColumn("__earlier", (F.row_number().over(peers) - 1).cast("long")), df.filter(F.col("__us").isNull())

    def _step(self) -> int:
        return min(max(1, self.d // timedelta(microseconds=1)), 1 << 61)

    def _ranged(self) -> WindowSpec:
        return Window.partitionBy("__bucket").orderBy("__us").rangeBetween(0, self._step() - 1)

    def _finished(self, spread: DataFrame, null: DataFrame, made: Column, name: str) -> Series:
        v = new_id()
        out = spread.withColumn(v, made).filter(F.col("__bucket") == F.col("__own")).select(*null.columns, v)
        out = out.unionByName(null.withColumn(v, F.lit(None).cast(out.schema[v].dataType))).drop("__us", "__key")
        return self.series._new(out, cols=[Field(name, v)], name=name, kind=Series)

    def _of_windows(self, name: str, then: Callable[[Column, Column], Column], own_only: bool = False, some: Column | None = None, distinct: bool = False) -> Series:
        """``then`` of each row's window, as an array of its values, and the row's place in it. ``some``, ``distinct``: what ``SEEN`` counts."""
        s, wants, sized = self.series, [], some is not None or distinct
        place = F.col("__place") if self.having else F.lit(0).cast("long")

        def element(back: bool, k: Any) -> Column:
            wants.append((back, k))
            return F.col(f"__e{len(wants) - 1}")

        made = _from_places(then(F.col("__all"), place), "__all", F.col("__size"), element)
        if made is None:
            return self._of_arrays(name, then, own_only)
        timed, kind = self.of.id == s.value.id, s.type()
        moment = lambda c: F.timestamp_micros(c).cast(kind if casts.is_time(kind) else "timestamp_ntz")
        df = s._sdf.withColumn("__us", F.unix_micros(casts.to_time(F.col(s.value.id), kind, s.options).cast("timestamp")))
        own = moment(F.col("__us")) if timed else F.col(self.of.id)
        v = new_id()
        if not self.having and not sized and wants and all(w == (False, 0) for w in wants) and "__size" not in str(made):
            # each window begins with its own row
            firsts = df.withColumns({f"__e{i}": own for i in range(len(wants))}).withColumn(v, F.when(F.col("__us").isNotNull(), made))
            return s._new(firsts.drop("__us", *(f"__e{i}" for i in range(len(wants)))), cols=[Field(name, v)], name=name, kind=Series)

        df = df.select(*dict.fromkeys([*(f.id for f in s.fields), self.of.id, *(c for c, _ in s.order)]), "__us")
        null = df.filter(F.col("__us").isNull())
        b = B.forward_ranges(df.filter(F.col("__us").isNotNull()), "__us", self._step(), s.order, some, distinct)
        held = {"__start": F.col(B.POS), B.END: F.col(B.END), "__first": F.col("__us"), B.UNTIL: F.col(B.UNTIL), **({B.SEEN: F.col(B.SEEN)} if sized else {})}
        test = self._passes((F.col(B.END) - F.col(B.POS)).cast("int"))
        if test is not None:
            held = {c: F.when(test, x) for c, x in held.items()}
        rows = b.df.withColumns(held)
        if test is not None and not own_only:
            # both ends of windows ascend: the last one that passes and begins at or before the row holds it, or none does
            names = {c: f"{c}_held" for c in held}
            rows = B.carried(B.Blocks(rows, b.size, b.counts), names, True)
            rows = rows.withColumns({c: F.when(F.col(B.POS) < F.col(names[B.END]), F.col(x)) for c, x in names.items()}).drop(*names.values())
        rows = rows.withColumns({"__size": (F.col(B.END) - F.col("__start")).cast("int"), "__place": F.col(B.POS) - F.col("__start")})
        whole = F.col("__start").isNotNull()
        for i, (back, k) in enumerate(wants):
            e, k = f"__e{i}", F.lit(k) if (fixed := type(k) is int) else k
            zero = fixed and wants[i][1] == 0
            if zero and (timed or not back and test is None):
                rows = rows.withColumn(e, moment(F.col(B.UNTIL if back else "__first")) if timed else own)
                continue
            inside = (k >= 0) & (k < F.col("__size"))
            if fixed and not back and test is None and wants[i][1] > 0:
                rows = B.shifted(B.Blocks(rows.withColumn("__own", own), b.size, b.counts), -wants[i][1], {"__own": e})
                rows = rows.withColumn(e, F.when(inside, F.col(e))).drop("__own")
                continue
            at = F.when(inside, F.col(B.END) - 1 - k if back else F.col("__start") + k).cast("long")
            values = b.df.select(F.col(B.POS).alias("__q"), own.alias(e))
            lone = rows.withColumn("__at", at)
            rows = lone.join(values, F.col("__at") == F.col("__q"), "left").drop("__at", "__q")
        out = rows.withColumn(v, F.when(whole, made)).select(*null.columns, v)
        out = out.unionByName(null.withColumn(v, F.lit(None).cast(out.schema[v].dataType))).drop("__us")
        return s._new(out, cols=[Field(name, v)], name=name, kind=Series)

    def _of_arrays(self, name: str, then: Callable[[Column, Column], Column], own_only: bool) -> Series:
        spread, null = self._spread([0, 1, -1] if self.having else [0, 1])
        of = F.col("__us") if self.of.id == self.series.value.id else F.col(self.of.id)
        kind = self.series.type() if self.of.id == self.series.value.id else None
        order = Window.partitionBy("__bucket").orderBy("__us", "__key")
        spread = spread.withColumn("__n", F.row_number().over(order))
        items = F.transform(F.array_sort(F.collect_list(F.struct("__us", "__key", F.struct(of.alias("v")).alias("x"))).over(self._ranged())), lambda y: y["x"]["v"])
        rows = F.slice(items, F.col("__earlier").cast("int") + 1, F.greatest(F.size(items), F.lit(1)))
        if kind is not None:  # a time travels as a number
            rows = F.transform(rows, lambda x: F.timestamp_micros(x).cast(kind if casts.is_time(kind) else "timestamp_ntz"))
        spread = spread.withColumn("__all", rows)
        test = self._passes(F.size("__all"))
        mine = F.struct(F.col("__all").alias("a"), F.col("__n").alias("n"))
        if test is not None and own_only:
            spread = spread.withColumn("__got", F.when(test, mine))
        elif test is not None:
            held = F.last(F.when(test & (F.col("__own") <= F.col("__bucket")), mine), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
            spread = spread.withColumn("__got", held)
            spread = spread.withColumn("__got", F.when(F.col("__n") < F.col("__got")["n"] + F.size(F.col("__got")["a"]), F.col("__got")))
        else:
            spread = spread.withColumn("__got", mine)
        got = F.col("__got")
        return self._finished(spread, null, F.when(got.isNotNull(), then(got["a"], F.col("__n") - got["n"])), name)

    def agg(self, kind: str) -> Series:
        name, c, of = self._named(kind), F.col(self.of.id), self.series.kind(self.of)
        if kind not in KINDS:
            raise ValueError(f"unknown reduction {kind!r}; one of {', '.join(KINDS)}")
        timed = self.of.id == self.series.value.id
        if timed and kind in ("earliest", "latest"):  # times ascend
            time = lambda x: casts.to_time(x, of, self.series.options) if casts.is_time(of) else x
            return self._of_windows(name, lambda a, _: time(F.get(a if kind == "earliest" else F.reverse(a), F.lit(0))))
        if kind == "count" or timed and kind == "nunique":
            seen = F.nullif(F.col(B.SEEN), F.lit(0).cast("long"))
            return self._of_windows(name, lambda a, _: seen, some=c.isNotNull() if kind == "count" else None, distinct=kind == "nunique")
        return self._of_windows(name, lambda a, _: _of_array(kind, a, of, self.series))

    def nth(self, n: int) -> Series:
        """The n-th row of each window (from its end if negative), null where there's none."""
        return self._of_windows(self._named("nth"), lambda a, _: F.get(a, F.lit(n)) if n >= 0 else F.get(F.reverse(a), F.lit(-n - 1)))

    def reduce(self, name: str, function: Callable) -> Series:
        """``function``: an array Column of a window's values to a Column, or an ``opaque`` one of a pandas Series of them to a value."""
        if getattr(function, "_opaque", False):
            call = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else function(pd.Series(list(x)))), function._kind or "double")
            return self._of_windows(self._named(name), lambda a, _: call(a))
        return self._of_windows(self._named(name), lambda a, _: function(a))

    def apply(self, function: Callable) -> RollingTime:
        if getattr(function, "_opaque", False):
            kind, plain = function._kind or self.series.kind(self.of).simpleString(), function
            function = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else list(plain(pd.Series(list(x))))), f"array<{kind}>")
        out = self._of_windows(self.of.name, lambda a, place: F.get(function(a), place.cast("int")))
        return RollingTime(out._new(cols=[self.series.value], name=self.series.name), self.d, out.value, self.having)

    def _windows(self) -> Series:
        return self._of_windows("windows", lambda a, _: a, own_only=True)

    def __len__(self) -> int:
        got = self._of_windows("rows", lambda a, _: F.size(a), own_only=True)
        return got._sdf.filter(F.col(got.value.id).isNotNull()).count()


def _of_array(kind: str, a: Column, of: T.DataType, frame: Frame) -> Column:
    """A reduction of an array of values in order, nulls included."""
    some = F.filter(a, lambda x: x.isNotNull())
    if kind == "count":
        return F.nullif(F.size(some).cast("long"), F.lit(0).cast("long"))
    if kind == "nunique":
        return F.nullif(F.size(F.array_distinct(some)).cast("long"), F.lit(0).cast("long"))
    if kind in ("first", "last"):
        return F.get(a if kind == "first" else F.reverse(a), F.lit(0))
    if kind in ("earliest", "latest"):
        times = F.transform(a, lambda x: casts.to_time(x, of, frame.options))
        return F.array_min(times) if kind == "earliest" else F.array_max(times)
    v = F.filter(F.transform(a, lambda x: casts.to_float(x, of)), lambda x: x.isNotNull())
    n = F.size(v)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda t, x: t + f(x))
    mean = F.when(n > 0, total(lambda x: x) / n)
    if kind == "stdDev":
        return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), total(lambda x: x * x) / n - mean * mean)))
    if kind == "median":
        u = F.array_sort(v)
        return F.when(n > 0, (F.get(u, F.floor((n - 1) / 2).cast("int")) + F.get(u, F.floor(n / 2).cast("int"))) / 2)
    return {"sum": F.when(n > 0, total(lambda x: x)), "mean": mean, "min": F.array_min(v), "max": F.array_max(v)}[kind]
