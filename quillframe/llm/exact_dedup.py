"""Exact deduplication over an extendible-hash index that lies in shared files.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Each row becomes a thin
entry: the 256-bit digest of that normalised text, its length in code points and its id. Entries of one digest are combined on
the map side, so a text that a third of all rows share reaches its owner as one entry from each batch. The 64-bit key space
is cut into equal ranges, each owned by one task, which inserts its entries into an extendible-hash index: a directory of
2**depth slots doubles when an overfull bucket can't split any other way; a bucket whose entries all share one key chains
overflow pages; entries that collide on the key are told apart by comparing all bytes of their digests. The owner's index
is then one file in the shared folder, written whole or not at all, which ``Index.open`` maps for later batches.

Nulls: a null text is empty, and all empty texts are equal. A null id sorts after every other. Repeated rows (same id, same
text) count one by one in ``group_size``, and one of them stays. Of equal texts of one length and id, the first row read stays. A text
of any length is digested whole, one at a time. An empty table gives an empty result. Extra columns of any name, dots included, pass
through ``deduplicated`` and are ignored by ``classes``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C

_DROP = b"\x20\x09\x0a\x0b\x0c\x0d"
_ENTRY = struct.Struct("<Q32sqqqq")  # key, digest, rows, best length, best id (or its absence), best row
_HEAD = struct.Struct("<4sHHQQ")
#: Entries of the largest index that one owner builds, on average.
OWNED = 50_000
_NO_ID = 2**63 - 1


class Index:
    """Extendible hashing of (key, digest) to (rows, best row).

    ``key`` bits below the owner's prefix choose the directory slot. ``capacity`` entries fit a bucket's first page; overflow
    pages of the same size chain behind it only if all its entries have one key.
    """

    def __init__(self, capacity: int = 64, skip: int = 0):
        self.capacity, self.skip, self.depth = capacity, skip, 0
        self.directory: list[list] = [[0, []]]  # each slot: [local depth, entries]

    def _slot(self, key: int, depth: int) -> int:
        return ((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> (64 - depth) if depth else 0

    def add(self, key: int, digest: bytes, rows: int, best: tuple[int, int, int]) -> None:
        """``best``: (minus code points, id, row); the smallest stays."""
        while True:
            bucket = self.directory[self._slot(key, self.depth)]
            for e in bucket[1]:
                if e[0] == key and e[1] == digest:  # all bytes
                    e[2] += rows
                    e[3] = min(e[3], best)
                    return
            if len(bucket[1]) < self.capacity or bucket[0] >= 64 - self.skip or all(e[0] == key for e in bucket[1]):
                bucket[1].append([key, digest, rows, best])
                return
            self._split(bucket, key)

    def _split(self, bucket: list, key: int) -> None:
        if bucket[0] == self.depth:
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        depth = bucket[0] + 1
        halves: list[list] = [[depth, []], [depth, []]]
        for e in bucket[1]:
            halves[self._slot(e[0], depth) & 1][1].append(e)
        first = (self._slot(key, depth) >> 1) << (self.depth - depth + 1)
        width = 1 << (self.depth - depth)
        for k in range(2):
            for i in range(width):
                self.directory[first + k * width + i] = halves[k]

    def buckets(self) -> Iterator[list]:
        last = None
        for b in self.directory:
            if b is not last:
                yield b
            last = b

    def entries(self) -> Iterator[list]:
        for b in self.buckets():
            yield from b[1]

    def save(self, uri: str) -> None:
        """Header, directory of (offset, entries), then each bucket's pages in a row."""
        pages, at, where = [], 0, {}
        for b in self.buckets():
            page = b"".join(_ENTRY.pack(k, d, n, -best[0], best[1], best[2]) for k, d, n, best in b[1])
            where[id(b)] = (at, len(b[1]))
            pages.append(page)
            at += len(page)
        slots = np.array([where[id(b)] for b in self.directory], np.uint64).tobytes()
        C.put_bytes(uri, [_HEAD.pack(b"XHIX", self.depth, self.skip, self.capacity, len(self.directory)), slots, *pages])

    @staticmethod
    def open(uri: str) -> StoredIndex:
        return StoredIndex(C.mapped(uri))


class StoredIndex:
    """An owner's file, mapped; a lookup reads one directory slot and one chain."""

    def __init__(self, data: np.ndarray):
        self.data = data
        mark, self.depth, self.skip, _, n = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if mark != b"XHIX":
            raise ValueError("not an index file")
        self.slots = np.frombuffer(data, np.uint64, 2 * n, _HEAD.size).reshape(n, 2)
        self.base = _HEAD.size + 16 * n

    def find(self, key: int, digest: bytes) -> tuple[int, int, int] | None:
        """Rows, id and code points of the text that stays, or None for a new text."""
        slot = ((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0
        at, n = (int(x) for x in self.slots[slot])
        for k, d, rows, length, best_id, _ in _ENTRY.iter_unpack(self.data[self.base + at : self.base + at + n * _ENTRY.size].tobytes()):
            if k == key and d == digest:
                return rows, best_id, length
        return None


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def _digests():
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = C.text_bytes(b.column(3))
        out, chars = [], np.empty(b.num_rows, np.int64)
        for i in range(b.num_rows):
            x = data[at[i] : at[i + 1]]
            chars[i] = np.count_nonzero((x & 0xC0) != 0x80)
            out.append(hashlib.sha256(x.tobytes().translate(None, _DROP)).digest())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(chars), pa.array(out, pa.binary())], names=["id", "no_id", "hash", "chars", "digest"])

    return f


def _combine():
    """One entry for each digest of a batch: its rows, and the best of them."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        digest = b.column(0).dictionary_encode()
        chars, i, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("chars", "id", "row"))
        i = np.where(b.column("no_id").to_numpy(zero_copy_only=False), _NO_ID, i)
        code = digest.indices.to_numpy()
        order = np.lexsort((row, i, -chars, code))
        first = order[np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])]
        cols = [digest.dictionary.take(pa.array(code[first])), pa.array(np.bincount(code)[code[first]]), pa.array(-chars[first]), pa.array(i[first]), pa.array(row[first])]
        return pa.RecordBatch.from_arrays(cols, names=["digest", "rows", "chars", "best_id", "best_row"])

    return f


def classes(docs: DataFrame, capacity: int = 64, index_dir: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``index_dir``: where the owners' index files go, a folder that driver and executors share; a new one by default.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    return _classed(rows, capacity, index_dir or C.shared_dir(spark)).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


_THIN = "id long, no_id boolean, hash long, chars long, digest binary"


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(*C.row_key(), F.col("text").cast("string").alias("text"))


def _rows(docs: DataFrame) -> DataFrame:
    rows = C.arrow_map(_thin(docs), _digests, _THIN)
    return C.written(rows.withColumn("row", F.monotonically_increasing_id()), f"{C.shared_dir(docs.sparkSession)}/rows")


def _classed(rows: DataFrame, capacity: int, to: str) -> DataFrame:
    spark = rows.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // OWNED))
    bits = max(1, (owners - 1).bit_length())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index | None = None
        held = -1

        def ended() -> Iterator[pa.RecordBatch]:
            if index is not None:
                index.save(f"{to}/{held:08x}.xhix")
                part = list(index.entries())
                for i in range(0, len(part), 50_000):
                    p = part[i : i + 50_000]
                    cols = [pa.array([e[1] for e in p], pa.binary()), pa.array([e[2] for e in p], pa.int64()), pa.array([None if e[3][1] == _NO_ID else e[3][1] for e in p], pa.int64()), pa.array([e[3][2] for e in p], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["digest", "group_size", "keep_id", "keep_row"])

        for b in batches:
            for owner, digest, n, chars, i, row in zip(*(b.column(c).to_pylist() for c in ("owner", "digest", "rows", "chars", "best_id", "best_row")), strict=True):
                if owner != held:
                    yield from ended()
                    index, held = Index(capacity, bits), owner
                index.add(key_of(digest), digest, n, (chars, i, row))
        yield from ended()

    entries = C.arrow_map(rows.select("digest", "id", "no_id", "chars", "row"), _combine, "digest binary, rows long, chars long, best_id long, best_row long")
    owner = F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits)
    dealt = entries.withColumn("owner", owner).repartition(owners, "owner").sortWithinPartitions("owner")
    groups = C.map_batches(dealt.select("owner", "digest", "rows", "chars", "best_id", "best_row"), own, "digest binary, group_size long, keep_id long, keep_row long")
    return rows.join(groups, "digest", "left").withColumn("kept", F.col("row") == F.col("keep_row"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = _rows(docs)
    return C.keep_rows(docs, _classed(rows, 64, C.shared_dir(docs.sparkSession)))


def duplicates_of(docs: DataFrame, index_dir: str, owner_bits: int) -> DataFrame:
    """Rows of a later batch looked up in stored index files: doc_id, known_id (null for a new text)."""
    files = f"{index_dir}/{{:08x}}.xhix"

    def make():
        held: dict[int, StoredIndex | None] = {}

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for digest in b.column("digest").to_pylist():
                key = key_of(digest)
                owner = key >> (64 - owner_bits)
                if owner not in held:
                    try:
                        held[owner] = Index.open(files.format(owner))
                    except FileNotFoundError:
                        held[owner] = None
                found = held[owner] and held[owner].find(key, digest)
                out.append(found[1] if found and found[1] != _NO_ID else None)
            ids = pa.array([None if n else i for i, n in zip(b.column("id").to_pylist(), b.column("no_id").to_pylist(), strict=True)], pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.int64())], names=["doc_id", "known_id"])

        return f

    return C.arrow_map(C.arrow_map(_thin(docs), _digests, _THIN), make, "doc_id long, known_id long")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
