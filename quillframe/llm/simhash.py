"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

A text's A-Z are lower-cased; its words ``[^\\x20\\x09-\\x0D]+`` give every run of three (a shorter text: all its words), joined by one
space and hashed by XXH64 with seed 42. A fingerprint bit is 1 if it is 1 in over half the hashes; a text without words has
fingerprint zero. Two fingerprints link when they differ in at most ``radius`` bits.

Distinct fingerprints are grouped by population count and cut into tiles of a bounded size. Two numbers that differ in d bits have
population counts that differ by at most d, so only pairs of tiles whose counts are within the radius are compared; the same bound on
the counts of 16-bit quarters skips blocks inside a pair. What remains is compared in full by exclusive-or and bit counts. A pair of
tiles returns the spanning forest of its links, never all of them; components are then found over the forests. Tiles are files in the
shared folder, which tasks map by name; the pairs come from a join of the tiles' names, so neither tiles nor pairs pass through the driver.

Nulls: a null text is empty; a null id has no say in ``component_id``, which is null for a component of null ids only. Repeated
rows share a fingerprint and so a component. An empty table gives an empty result. A text of any length is hashed whole, one at a time;
a word longer than others is hashed like them. ``deduplicated`` keeps extra columns of any name, ``classes`` ignores them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C
from quillframe.llm.components import components

#: Fingerprints of a tile at most, as its hash chunks come out on average.
TILE = 1 << 17
#: Comparisons at once.
BLOCK = 1 << 21
#: Tiles on either side of a square of pairs.
HELD = 8
#: Tiles from which quarters pay for their smaller blocks.
FINE = 12_000
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else (words,)
    hashes = np.array([h(x, 42) for x in map(b" ".join, runs)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(3))
            fp = np.array([fingerprint(data[at[i] : at[i + 1]].tobytes(), shingle) for i in range(b.num_rows)], np.uint64)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp.view(np.int64))], names=["id", "no_id", "hash", "fp"])

        return f

    return make


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """A written table of the rows' keys and fingerprints (as signed longs)."""
    thin = docs.select(*C.row_key(), F.col("text").cast("string").alias("text"))
    return C.written(C.arrow_map(thin, _fingerprints(shingle), "id long, no_id boolean, hash long, fp long"), f"{C.shared_dir(docs.sparkSession)}/fps")


def _blocks(fps: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints by the population counts of ``parts`` equal parts."""
    width = 64 // parts
    mask = np.uint64((1 << width) - 1)
    counts = np.stack([np.bitwise_count((fps >> np.uint64(width * k)) & mask) for k in range(parts)], axis=1).astype(np.int16)
    order = np.lexsort(counts.T)
    counts, fps = counts[order], fps[order]
    cut = np.flatnonzero(np.any(counts[1:] != counts[:-1], axis=1)) + 1 if len(fps) else []
    return list(zip(counts[np.r_[0, cut]] if len(fps) else [], np.split(fps, cut), strict=True)) if len(fps) else []


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a or b that has a link, with its component's root; the roots link to themselves no more."""
    parts = _parts(len(a), len(b))
    return _forest(_blocks(a, parts), _blocks(b, parts), radius, same)


def _parts(*sizes: int) -> int:
    return 4 if min(sizes) >= FINE else 2


def _forest(left: list, right: list, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([c for c, _ in right], np.int16)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for i, (c, x) in enumerate(left):
        for j in np.flatnonzero(np.abs(at - c).sum(1) <= radius):
            if same and j < i:
                continue
            y = right[j][1]
            step = max(1, BLOCK // len(y))
            for k in range(0, len(x), step):
                p, q = np.nonzero(np.bitwise_count(x[k : k + step, None] ^ y[None, :]) <= radius)
                for u, v in zip(x[k + p].tolist(), y[q].tolist(), strict=True):
                    if u != v and (u := root(u)) != (v := root(v)):
                        parent[max(u, v)] = min(u, v)
    nodes = [x for x in parent if root(x) != x]
    return np.array(nodes, np.uint64), np.array([root(x) for x in nodes], np.uint64)


def _store(to: str):
    """Writes each tile as a file of sorted fingerprints."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            n = []
            for pc, chunk, fps in zip(b.column("pc").to_pylist(), b.column("chunk").to_pylist(), b.column("fps"), strict=True):
                x = np.sort(np.asarray(fps.values, np.int64).view(np.uint64))
                C.put_bytes(f"{to}/{pc:02d}-{chunk:08x}", [x.tobytes()])
                n.append(len(x))
            return pa.RecordBatch.from_arrays([b.column("pc"), b.column("chunk"), pa.array(n, pa.int64())], names=["pc", "chunk", "n"])

        return f

    return make


def _compare(to: str, radius: int):
    def make():
        @lru_cache(2 * HELD)
        def tile(pc: int, chunk: int, parts: int) -> list:
            return _blocks(np.frombuffer(C.mapped(f"{to}/{pc:02d}-{chunk:08x}"), np.uint64), parts)

        def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for pa_, ca, na, pb, cb, nb in zip(*(b.column(c).to_pylist() for c in ("pa", "ca", "na", "pb", "cb", "nb")), strict=True):
                parts = _parts(na, nb)
                out.append(_forest(tile(pa_, ca, parts), tile(pb, cb, parts), radius, (pa_, ca) == (pb, cb)))
            u, v = (np.concatenate([x[k] for x in out]).view(np.int64) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"]) if len(u) else None

        return f

    return make


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """The pairs of ``tiles`` (pc, chunk, n) to compare, each once, and the square of pairs it belongs to: those of a square share their tiles."""
    side = lambda x: tiles.select(F.col("pc").alias(f"p{x}"), F.col("chunk").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
    near = side("a").withColumn("pb", F.explode(F.sequence(F.col("pa"), F.col("pa") + radius)))
    both = near.join(side("b"), "pb").filter("pa < pb or ca <= cb")
    return both.withColumn("square", F.struct("pa", "pb", F.floor(F.col("ca") / HELD).alias("a"), F.floor(F.col("cb") / HELD).alias("b")))


def linked(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``fps`` (fp long, distinct) gives (node, label) of every fingerprint with a link to another."""
    spark = fps.sparkSession
    to = C.shared_dir(spark)
    fps = fps.withColumn("pc", F.bit_count("fp"))
    # at most 65 rows, whatever the input
    counts = {r["pc"]: -(-r["n"] // tile) for r in fps.groupBy("pc").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fps.select(F.col("fp").alias("node"), F.col("fp").alias("label")).limit(0)
    chunks = F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("pc"))
    tiles = fps.select("pc", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"), "fp").groupBy("pc", "chunk").agg(F.collect_list("fp").alias("fps"))
    tiles = C.written(C.arrow_map(tiles, _store(f"{to}/tiles"), "pc int, chunk int, n long"), f"{to}/meta")
    work = tile_pairs(tiles, radius).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, sum(counts.values())), "square")
    work = work.sortWithinPartitions("square", "ca", "cb").select("pa", "ca", "na", "pb", "cb", "nb")
    return components(C.arrow_map(work, _compare(f"{to}/tiles", radius), "a long, b long"))


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, best): one row for each fingerprint; best is the key of its component's first row."""
    key = F.struct("no_id", "id", "hash")
    own = C.written(rows.groupBy("fp").agg(F.min(F.when(~F.col("no_id"), F.col("id"))).alias("first_id"), F.min(key).alias("first")), f"{C.shared_dir(rows.sparkSession)}/own")
    links = linked(own.select("fp"), radius)
    labelled = own.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("first").alias("best"))
    return labelled.select("fp", "label").join(firsts, "label").drop("label")


def classes(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = fingerprints(docs, shingle)
    out = rows.join(_components(rows, radius), "fp")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (null last)."""
    rows = fingerprints(docs, shingle)
    judged = rows.join(_components(rows, radius), "fp")
    return C.keep_rows(docs, judged.select(*C.KEY, (F.struct("no_id", "id", "hash") == F.col("best")).alias("kept")))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
