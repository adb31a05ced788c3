"""Mixing sources to target weights by cube-method balanced sampling.

A text's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, by code point and null last, weigh 1, 2, 3, repeating, and share
all sizes by weight; a target stops at ``most`` (3) times its source's size and the excess is shared again until none is above. A
document of a source with target / size = k + f is taken k times for certain and once more with probability f.

Those fractional probabilities are a point in a cube. The flight phase moves it, three documents at a time, along the null space of its
source's two constraints (total words, total documents) until one of the three is 0 or 1, so both totals stay exactly met. What can't be
met so is a document cut in two, so the large documents of a source, those of more than a ``NEAR`` of its words (fewer than 1 / ``NEAR``),
are settled first, in classes of halving size: a class flies, its last two fractions at most land at random, each with its own
probability, and what that lacks or has too much in words moves the probabilities of all smaller documents alike, up as often as down.
The small documents of a source are dealt into blocks by a hash, each block flies on its own and leaves at most two documents
undecided; these fly again in ever fewer blocks, until at most two of a source are left. They meet a reserve of about ``RESERVE`` documents
of each source, an eighth of it at most, that waited for this, fly once more, and at most two fractions land at random. What is then off
is made up by at most ``MOVES`` exchanges in the reserve, as many in as out (and, only where that ends beyond ``NEAR`` of the target, at
most as many single ones): the one step that shifts probabilities, of those few documents. All randomness comes from hashes: reruns agree.

Nulls: a null text has size 0; null is a source of its own, the last. Rows that share id, text and source are one unit
and are taken equally often; documents of equal size fly by the hash of their key. A source without words has target 0 and is not taken. A
source of few documents misses its target by part of its smallest ones, since none is cut. An empty table gives an empty result. ``drawn`` keeps extra columns of any name, dots included; ``mixed`` ignores them.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm import common as C

#: Units of a block on average, and blocks that meet in the next round.
BLOCK, FAN = 2_000, 1_000
#: Units of each source that wait for the landing, on average, and the share of a source that may.
RESERVE, SHARE = 256, 8
#: Exchanges at most, and the error beyond which single documents may go in or out.
MOVES, NEAR = 8, 0.002
#: Sources up to which the table of targets is broadcast, and numbered in one task.
SMALL = 50_000
_EPS = 1e-9


def fly(f: list[float], size: list[float], count: list[float], seed: int) -> list[float]:
    """Moves ``f`` along the null space of (size, count) until at most two are strictly between 0 and 1. Units fly in the order given."""
    f, draw = list(f), random.Random(seed)
    held: list[int] = []
    for i in range(len(f)):
        if not _EPS < f[i] < 1 - _EPS:
            f[i] = float(round(f[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            # the cross product of both constraints, scaled so that the numbers stay tame
            s, n = [size[k] for k in (a, b, c)], [count[k] for k in (a, b, c)]
            u = (s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0])
            top = max(abs(x) for x in u)
            if top == 0:  # dependent constraints: one is enough
                u = (n[1], -n[0], 0.0)
                top = max(n[0], n[1])
            u = [x / top for x in u]
            up = min(((1 - f[k]) / x if x > 0 else -f[k] / x) for k, x in zip(held, u, strict=True) if x)
            down = min((f[k] / x if x > 0 else (f[k] - 1) / x) for k, x in zip(held, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            left = []
            for k, x in zip(held, u, strict=True):
                f[k] += step * x
                if _EPS < f[k] < 1 - _EPS:
                    left.append(k)
                else:
                    f[k] = float(round(f[k]))
            held = left
    return f


def land(f: list[float], seed: int) -> list[float]:
    """Systematic sampling of the few fractions that are left: each goes to 1 with its own probability, their number stays within one."""
    out, at = [float(round(x)) for x in f], random.Random(seed).random()
    for i, x in enumerate(f):
        if _EPS < x < 1 - _EPS:
            out[i], at = float(math.floor(at + x) > math.floor(at)), at + x
    return out


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: 1 and on by code point, null last."""
    spark, keys = sources.sparkSession, [F.col("source").isNull(), F.col("source").cast("binary")]
    if sources.count() <= SMALL:
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = sources.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id())
    part = C.written(part.withColumn("part", F.shiftright("row", 33).cast("int")), f"{C.shared_dir(spark)}/numbered")
    held, before = {r["part"]: r["count"] for r in part.groupBy("part").count().collect()}, []  # one row for each partition
    for k in range(n):
        before.append(sum(before[-1:]) + held.get(k - 1, 0))
    at = F.get(F.array(*(F.lit(x).cast("long") for x in before)), F.col("part"))
    return part.withColumn("rank", at + F.col("row").bitwiseAND((1 << 33) - 1) + 1).drop("row", "part")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, n_rows) gives these, rank, and target, a double."""
    t = _numbered(sizes).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    t = C.written(t, f"{C.shared_dir(sizes.sparkSession)}/targets")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(most) * F.col("source_size")
    level, seen = None, -1
    while True:  # each round caps more sources, so this ends
        over = F.lit(False) if level is None else F.col("weight") * level >= cap
        r = t.agg(F.sum(F.when(over, cap).otherwise(0)).alias("cap"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(over.cast("int")).alias("n")).first()
        if r["n"] is None or r["n"] == seen or not r["weight"]:
            break
        seen, level = r["n"], (total - r["cap"]) / r["weight"]
    return t.select("source", "source_size", "n_rows", "rank", F.least(F.col("weight") * F.lit(level or 0.0), cap.cast("double")).alias("target"))


def settle(f: list[float], size: list[float], free: list[bool], want: float, near: float) -> list[float]:
    """Exchanges a taken and an untaken ``free`` unit, the best pair first, while the size taken comes nearer to ``want``; ``MOVES`` times at most."""
    f, s, free = np.array(f), np.array(size), np.array(free)
    off = want - float((f * s).sum())
    for alone in (False, True):
        for _ in range(MOVES):
            if alone and abs(off) <= near:
                break
            ones, zeros = np.flatnonzero(free & (f == 1)), np.flatnonzero(free & (f == 0))
            if alone:  # one side of the exchange may be nobody
                change = np.r_[-s[ones], s[zeros]]
                pairs = [(i, None) for i in ones] + [(None, j) for j in zeros]
            else:
                change = (s[zeros][None, :] - s[ones][:, None]).ravel()
                pairs = None
            if not len(change):
                break
            k = int(np.argmin(np.abs(off - change)))
            if abs(off - change[k]) >= abs(off) - 1e-6:
                break
            i, j = pairs[k] if alone else (ones[k // len(zeros)], zeros[k % len(zeros)])
            if i is not None:
                f[i] = 0.0
            if j is not None:
                f[j] = 1.0
            off -= float(change[k])
    return f.tolist()


def _round(rows: DataFrame, last: bool) -> DataFrame:
    """Flies every (source, block) on its own."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        # nothing here depends on the order in which rows arrive
        p = p.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        seed = hash((int(p["rank"].iloc[0]), int(p["unit"].iloc[0]), len(p)))
        size, start = p["size"].tolist(), p["f"].tolist()
        got = fly(start, size, p["rows"].tolist(), seed)
        if last:
            want = math.fsum(x * y for x, y in zip(start, size, strict=True))
            got = settle(land(got, seed + 1), size, [_EPS < x < 1 - _EPS for x in start], want, NEAR * float(p["target"].iloc[0]))
        return p.assign(f=got)[["unit", "rank", "rows", "size", "f", "target", "block"]]

    C.ship(rows.sparkSession)
    return rows.groupBy("rank", "block").applyInPandas(f, "unit long, rank long, rows double, size double, f double, target double, block long")


def ladder(size: list[float], rows: list[float], target: float, total: float, most: int, seed: int) -> list[float]:
    """Copies of a source's large units, in descending order of ``size``, class by class; ``total``: the words of the source, small units included."""
    out, got, left, i = [0.0] * len(size), 0.0, total, 0
    while i < len(size):
        level = math.floor(math.log2(total / size[i]) + _EPS)
        j = i
        while j < len(size) and math.floor(math.log2(total / size[j]) + _EPS) == level:
            j += 1
        ratio = min(max((target - got) / left, 0.0), float(most))
        whole = math.floor(ratio + _EPS)
        f = fly([max(0.0, ratio - whole)] * (j - i), size[i:j], rows[i:j], seed + i)
        out[i:j] = [whole + x for x in land(f, seed - i - 1)]
        got += math.fsum(x * y for x, y in zip(out[i:j], size[i:j], strict=True))
        left -= math.fsum(size[i:j])
        i = j
    return out


def _settled_large(large: DataFrame, most: int) -> DataFrame:
    """(unit, rank, copies, size) of the large units; a source has fewer than 1 / ``NEAR``."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        seed = hash((int(p["rank"].iloc[0]), int(p["unit"].iloc[0]), len(p), 1))
        return p.assign(copies=ladder(p["size"].tolist(), p["rows"].tolist(), float(p["target"].iloc[0]), float(p["source_size"].iloc[0]), most, seed))[["unit", "rank", "copies", "size"]]

    C.ship(large.sparkSession)
    return large.select("unit", "rank", "rows", "size", "target", "source_size").groupBy("rank").applyInPandas(f, "unit long, rank long, copies double, size double")


def decided(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row for each unit (rows of one id, text and source): its key, copies, source_size, target. See the module."""
    spark = docs.sparkSession
    to = C.shared_dir(spark)
    rows = docs.select(*C.row_key("text", "source"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = C.written(rows, f"{to}/rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), most)
    goal = C.written(goal, f"{to}/goal")
    few = goal.count() <= SMALL
    small_table = lambda df: F.broadcast(df) if few else df  # noqa: E731  a row for each of at most SMALL sources
    units = rows.groupBy(*C.KEY, "source").agg(F.count("*").cast("double").alias("rows"), F.sum("size").cast("double").alias("size"), F.min("size").alias("one"))
    near = small_table(goal)
    units = units.join(near, units["source"].eqNullSafe(near["source"])).drop(near["source"])
    units = units.withColumns({"large": F.col("size") > F.col("source_size") * NEAR, "unit": F.xxhash64(*C.KEY, "source")})
    units = C.written(units, f"{to}/units")
    large = C.written(_settled_large(units.filter("large"), most), f"{to}/large")
    spent = large.groupBy("rank").agg(F.sum(F.col("copies") * F.col("size")).alias("spent"), F.sum("size").alias("gone"))
    ratio = F.when(F.col("left") > 0, (F.col("target") - F.col("spent")) / F.col("left")).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.join(spent, "rank", "left").fillna(0.0, ["spent", "gone"]).withColumn("left", F.col("source_size") - F.col("gone"))
    goal = goal.select("rank", "n_rows", "target", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), ratio)).alias("ratio"))
    goal = C.written(goal.coalesce(1) if few else goal, f"{to}/rest")
    whole = F.floor(F.col("ratio") + F.lit(_EPS))
    small = units.filter("not large").select("unit", "rank", "rows", "size").join(small_table(goal), "rank").withColumns({"whole": whole, "f": F.greatest(F.lit(0.0), F.col("ratio") - whole)})
    # a source's blocks follow its own size: no group holds two sources or grows with one
    own, k = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK)), 0
    blocks = goal.agg(F.max(own)).first()[0] or 1
    waits = F.pmod(F.xxhash64("unit", F.lit(6)), F.col("n_rows")) < F.least(F.lit(RESERVE), F.floor(F.col("n_rows") / SHARE))
    all_ = small.select("unit", "rank", "rows", "size", "f", "target", F.pmod(F.xxhash64("unit", F.lit(5)), own).alias("block"), waits.alias("waits"))
    reserve = all_.filter("waits").drop("waits").withColumn("block", F.lit(0).cast("long"))
    left, settled = all_.filter("not waits").drop("waits"), None
    while True:
        flown = C.written(_round(left, False), f"{to}/round{k}")
        done = flown.filter("f = 0 or f = 1").select("unit", F.col("f").alias("extra"))
        settled = done if settled is None else settled.unionByName(done)
        left = flown.filter("f > 0 and f < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        if blocks == 1:
            break
        blocks, k = -(-blocks // FAN), k + 1
    settled = settled.unionByName(C.written(_round(left.unionByName(reserve), True), f"{to}/landed").select("unit", F.col("f").alias("extra")))
    settled = settled.unionByName(large.select("unit", F.col("copies").alias("extra"))).groupBy("unit").agg(F.max("extra").alias("extra"))
    base = F.when(F.col("large"), F.lit(0)).otherwise(whole).cast("long")
    out = units.join(small_table(goal.select("rank", "ratio")), "rank").join(settled, "unit")
    return out.select(*C.KEY, "source", "one", (base + F.col("extra").cast("long")).alias("copies"), "source_size", "target"), rows


def mixed(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken (size times copies)."""
    unit, rows = decided(docs, most)
    out = rows.select(*C.KEY, "size").join(unit, list(C.KEY))
    return out.select(F.when(~F.col(C.KEY[1]), F.col(C.KEY[0])).alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def drawn(docs: DataFrame, most: int = 3) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    unit, _ = decided(docs, most)
    out = C.with_key(docs, "text", "source").join(unit.filter("copies > 0").select(*C.KEY, "copies"), list(C.KEY))
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
