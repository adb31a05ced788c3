"""Positions and prefix computations over a total order, without putting all rows into one task.

Rows are dealt by ranges of the order into blocks, sorted within each, and kept: block k holds what comes before block k + 1. What a
block needs to know of those before it (how many rows, a running sum, the last value that isn't null) is one small row for each
block; everything else happens inside blocks, in parallel. The kept rows make sure that every use sees the same blocks. Frames deal only
the columns that they have, once for all operators of one frame; ``release`` lets go of what is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK, ROW, POS = "__block", "__row", "__pos"
#: Of a row's window of time: the position after it, the time of its last row, what is counted in it.
END, UNTIL, SEEN = "__stop", "__until", "__seen"
#: Rows of a block of positions, for windows over positions.
SPAN = 1 << 20
#: Rows of a table that is broadcast at most.
FEW = 1 << 18
_kept: list[DataFrame] = []


def release() -> None:
    """Drops kept rows. Frames that came of positions must not be used any more."""
    while _kept:
        _kept.pop().unpersist()


def directed(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Nulls last in both directions."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


@dataclass(frozen=True)
class Blocks:
    df: DataFrame  # with BLOCK, ROW (from 0 in its block) and POS
    size: int
    counts: tuple[int, ...]  # rows of each block

    @property
    def blocks(self) -> int:
        return len(self.counts)


def _ids(df: DataFrame, row: Column) -> DataFrame:
    """BLOCK and ROW from ids of (partition, row of it)."""
    return df.withColumns({BLOCK: F.shiftright(row, 33).cast("int"), ROW: row.bitwiseAND((1 << 33) - 1)})


def _at(values: Sequence, kind: str) -> Column:
    """The value of a row's block."""
    return F.get(F.array(*(F.lit(x).cast(kind) for x in values)), F.col(BLOCK))


def _counted(part: DataFrame, least: int = 0) -> Blocks:
    held = {r[0]: r[1] for r in part.groupBy(BLOCK).count().collect()}  # one row for each block
    counts = tuple(held.get(k, 0) for k in range(max([least, *(k + 1 for k in held)])))
    starts = [0]
    for n in counts:
        starts.append(starts[-1] + n)
    return Blocks(part.withColumn(POS, _at(starts[:-1] or [0], "long") + F.col(ROW)), starts[-1], counts)


def blocks_of(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Blocks:
    """Positions 0..n-1 by ``order``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = directed(order)
    part = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id())
    part = _ids(part, F.col(ROW))
    # a cluster that names a shared folder keeps the rows there, where no lost executor takes them; else the executors keep them on
    # disk, and what is lost is made again with the same ranges
    if spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        part = part.checkpoint()
    else:
        _kept.append(part := part.persist(StorageLevel.DISK_ONLY))
    return _counted(part, n)


_STABLE = {"Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias", "View", "LogicalRDD", "LocalRelation"}


def read_order(df: DataFrame, row: str) -> Blocks:
    """Positions in the order of reading, for ``df`` with its row ids (``monotonically_increasing_id``) in ``row``: nothing is sorted or moved.

    What reads other rows, or in another order, on a second run (anything but a scan with projections) is kept first.
    """

    def scanned(plan) -> bool:
        name = plan.nodeName().split(" ")[0].split("(")[0]
        return name in _STABLE and all(scanned(plan.children().apply(k)) for k in range(plan.children().size()))

    if not scanned(df._jdf.queryExecution().optimizedPlan()):
        if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
            df = df.checkpoint()
        else:
            _kept.append(df := df.persist(StorageLevel.DISK_ONLY))
    return _counted(_ids(df, F.col(row)))


def _inside() -> WindowSpec:
    return Window.partitionBy(BLOCK).orderBy(ROW)


def running_sum(b: Blocks, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to each row; a null adds nothing."""
    v = "__v"
    df = b.df.withColumn(v, F.coalesce(value, F.lit(0.0)))
    sums = {r[0]: r[1] for r in df.groupBy(BLOCK).agg(F.sum(v)).collect()}  # one row for each block
    before, total = [], 0.0
    for k in range(b.blocks):
        before.append(total)
        total += sums.get(k) or 0.0
    return df.withColumn(name, _at(before or [0.0], "double") + F.sum(v).over(_inside().rowsBetween(Window.unboundedPreceding, 0))).drop(v)


def carried(b: Blocks, columns: dict[str, str], forward: bool) -> DataFrame:
    """For each (source: name), the last value at or before each row that isn't null (at or after, if not ``forward``); null if none."""
    if not columns:
        return b.df
    edge = F.max_by if forward else F.min_by
    got = b.df.groupBy(BLOCK).agg(*(edge(c, F.when(F.col(c).isNotNull(), F.col(ROW))).alias(c) for c in columns))
    rows = {r[BLOCK]: r for r in got.collect()}  # one row for each block
    held: dict = dict.fromkeys(columns)
    table: dict[str, list] = {c: [None] * max(1, b.blocks) for c in columns}
    for k in range(b.blocks) if forward else range(b.blocks - 1, -1, -1):
        for c in columns:
            table[c][k] = held[c]
            if k in rows and rows[k][c] is not None:
                held[c] = rows[k][c]
    # a frame that begins at the row is worked out anew for each row, in the square of the block; backward, rows are read from the end
    w = Window.partitionBy(BLOCK).orderBy(ROW if forward else F.desc(ROW)).rowsBetween(Window.unboundedPreceding, 0)
    kind = {c: b.df.schema[c].dataType.simpleString() for c in columns}
    return b.df.withColumns({name: F.coalesce(F.last(c, ignorenulls=True).over(w), _at(table[c], kind[c])) for c, name in columns.items()})


def forward_rows(b: Blocks, n: int, aggregates: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``aggregates``, functions of a window, over each row and the n - 1 after it. Rows whose window is not complete have that of the last complete one.

    Blocks of positions overlap by n - 1 rows, so a window never leaves its block; the last rows stay with the last complete window.
    """
    if n > b.size:
        return b.df.withColumns({k: F.lit(None).cast("double") for k in aggregates})
    span, block = max(SPAN, 4 * n), "__span"
    own = F.floor(F.least(F.col(POS), F.lit(b.size - n)) / span)
    here = F.floor(F.col(POS) / span)
    copies = F.when((F.col(POS) % span < n - 1) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    spread = b.df.withColumn(block, F.explode(copies))
    w = Window.partitionBy(block).orderBy(POS)
    full = F.col(POS) <= b.size - n
    last = lambda k: F.last(F.when(full, F.struct(k)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))[k]
    got = spread.withColumns({k: a(w.rowsBetween(0, n - 1)) for k, a in aggregates.items()}).withColumns({k: last(k) for k in aggregates})
    return got.filter(F.col(block) == own).drop(block)


def forward_ranges(df: DataFrame, at: str, step: int, order: Sequence[tuple[str, bool]], some: Column | None = None, distinct: bool = False) -> Blocks:
    """Rows by ``at`` (a long, not null) and, where equal, by ``order``, each with its window: itself and the rows after it that are less than ``step`` later.

    END: the position after the window's last row; UNTIL: ``at`` of that row. SEEN: how many rows of the window pass ``some`` or, with
    ``distinct``, how many values of ``at`` it has. A row is dealt to its own place and to the end of its window; windows have the order of
    their first rows, so what comes before the two tells both positions. No window is read, whatever it holds.
    """
    time, end, test, new = "__at", "__end", "__test", "__new"
    keys = list(dict.fromkeys(c for c, _ in order if c != at))
    passes = F.coalesce(F.lit(False) if some is None else some, F.lit(False)).cast("long").alias(test)
    places = df.select(*keys, F.col(at).alias(time), F.lit(0).alias(end), passes)
    ends = df.select("*", (F.col(at) + (step - 1)).alias(time), F.lit(1).alias(end), passes)
    b = blocks_of(ends.unionByName(places, allowMissingColumns=True), [(time, True), (end, True), *((c, up) for c, up in order if c != at)])
    made = [F.count("*"), F.sum(test), F.min(time), F.max(time), *([F.count_distinct(time)] if distinct else [])]
    got = {(r[0], r[1]): r[2:] for r in b.df.groupBy(BLOCK, end).agg(*made).collect()}  # two rows for each block
    before = {kind: [] for kind in (0, 1)}  # of places and ends before each block: rows, those that pass, the last time, its values
    for kind, table in before.items():
        rows, passed, last, values = 0, 0, None, 0
        for k in range(max(1, b.blocks)):
            table.append((rows, passed, last, values))
            if r := got.get((k, kind)):
                rows, passed, values = rows + r[0], passed + r[1], values + (r[4] - (r[2] == last) if distinct else 0)
                last = r[3]
    of = lambda kind, k: _at([r[k] for r in before[kind]], "long")
    w = _inside().rowsBetween(Window.unboundedPreceding, 0)
    is_end = F.col(end) == 1
    made = {"__ends": of(1, 0) + F.sum(end).over(w), UNTIL: F.coalesce(F.last(F.when(~is_end, F.col(time)), ignorenulls=True).over(w), of(0, 2))}
    if some is not None:
        here, all_ = (F.sum(F.when(x, F.col(test)).otherwise(0)).over(w) for x in (is_end, ~is_end))
        made[SEEN] = of(0, 1) + all_ - of(1, 1) - here + F.col(test)
    df = b.df
    if distinct:
        held = _inside().rowsBetween(Window.unboundedPreceding, -1)
        past = [F.last(F.when(x, F.col(time)), ignorenulls=True).over(held) for x in (~is_end, is_end)]
        df = df.withColumn(new, (~F.col(time).eqNullSafe(F.when(is_end, F.coalesce(past[1], of(1, 2))).otherwise(F.coalesce(past[0], of(0, 2))))).cast("long"))
        here, all_ = (F.sum(F.when(x, F.col(new)).otherwise(0)).over(w) for x in (is_end, ~is_end))
        made[SEEN] = of(0, 3) + all_ - of(1, 3) - here + 1
    df = df.withColumns(made).filter(is_end)
    # only ends go on: they stand for their rows, whose positions they have
    df = df.withColumn(END, F.col(POS) - F.col("__ends") + 1).withColumn(POS, F.col("__ends") - 1).withColumn(ROW, F.col(POS) - of(1, 0))
    counts = tuple(r[0] if (r := got.get((k, 1))) else 0 for k in range(b.blocks))
    return Blocks(df.drop("__ends", time, end, test, new), sum(counts), counts)


def shifted(b: Blocks, n: int, columns: dict[str, str]) -> DataFrame:
    """For each (source: name), the value n rows before (after, if negative), null where there's none.

    Inside a block that is ``lag``; the |n| rows at its edge are handed over by position.
    """
    far = lambda c: (F.lag(c, n) if n >= 0 else F.lead(c, -n)).over(_inside())
    inner = b.df.withColumns({name: far(c) for c, name in columns.items()})
    if not n or b.blocks < 2:
        return inner
    size = _at(b.counts, "long")
    leaves, lacks = (F.col(ROW) >= size - n, F.col(ROW) < n) if n > 0 else (F.col(ROW) < -n, F.col(ROW) >= size + n)
    names = {name: f"__h{k}" for k, name in enumerate(columns.values())}
    over = b.df.filter(leaves).select((F.col(POS) + n).alias("__at"), *(F.col(c).alias(names[name]) for c, name in columns.items()))
    if abs(n) * b.blocks <= FEW:
        df = inner.join(F.broadcast(over), F.when(lacks, F.col(POS)) == F.col("__at"), "left")  # |n| rows of each block
    else:
        edge = b.df.filter(lacks).withColumns({name: F.lit(None).cast(inner.schema[name].dataType) for name in names})
        return inner.filter(~lacks).unionByName(edge.join(over, F.col(POS) == F.col("__at"), "left").withColumns({x: F.col(h) for x, h in names.items()}).select(*inner.columns))
    return df.withColumns({x: F.when(lacks, F.col(h)).otherwise(F.col(x)) for x, h in names.items()}).drop("__at", *names.values())


def dense_ranks(df: DataFrame, value: str, rank: str, below: str) -> tuple[DataFrame, int]:
    """``df`` with the dense rank of each value, how many rows are strictly below it, and how many rows have a value. Nulls take no part and have nulls.

    Ranks are worked out over the distinct values and joined back: by a broadcast where these are few.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    b = blocks_of(per, [(value, True)])
    got = running_sum(b, F.col("__n").cast("double"), below)
    got = got.select(F.col(value).alias("__v"), (F.col(POS) + 1).cast("double").alias(rank), (F.col(below) - F.col("__n")).alias(below))
    total = b.df.agg(F.sum("__n")).first()[0] or 0
    some, none = df.filter(F.col(value).isNotNull()), df.filter(F.col(value).isNull())
    out = some.join(F.broadcast(got) if b.size <= FEW else got, F.col(value) == F.col("__v")).drop("__v")
    return out.unionByName(none.withColumns({c: F.lit(None).cast("double") for c in (rank, below)})), int(total)


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
