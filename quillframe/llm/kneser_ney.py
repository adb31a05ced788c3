"""Interpolated modified Kneser-Ney model of order three (or two): counted in Spark, stored as sorted hash arrays, memory-mapped by the workers.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, by 64-bit hash, and one end after each text. The model lies in the
shared folder as files of plain arrays, cut into shards:

* vocabulary: sorted word hashes, and their counts; a word's id is its place over all shards;
* bigrams: sorted keys (id of the first word, id of the second), and their counts;
* trigrams, in the shard of their first two words: for each bigram of that shard where its trigrams start and how many occur twice and more
  often; and of each trigram the third word's id and the count;
* lower counts: after how many words a bigram occurs;
* by id: in how many contexts a word occurs, how many of a context's bigrams count one, two, more, and the sum of those counts.

Counting: a task tallies its texts in sorted arrays of bounded size and sends them on as compressed blobs, dealt by hash; a shard's
task merges its blobs and writes its file whole or not at all. Contexts with more than their share of all tokens are dealt
by the whole bigram or trigram. Nothing of the vocabulary or the counts passes through the driver, only each shard's few totals and the
names of the contexts of two words that are dealt so, fewer than four for each shard.

p(w | uv) = (c(uvw) - D(c(uvw))) / c(uv) + g(uv) p(w | v). p(w | v) is the same of the bigrams, whose counts are the numbers of words
before them, save those of a text's start, which nothing precedes: they keep their own. p(w) comes from the numbers of contexts, discounted
likewise and interpolated with 1 / (V + 1). The discounts D for counts of 1, 2 and more come, in each order, from how many entries count 1 to 4. A
context never seen leaves the lower order; a text's first token has the start as its only context; a word never seen has the rest's share of
1 / (V + 1). In a model of order two the bigrams keep their own counts.

Nulls: a null text is empty: its one token is the end. A null id counts as the empty text for the fold. Repeated rows are counted
and scored one by one. A text of any length is counted and scored whole, as a chunk of its own. Without training rows V and N are 0 and every token has probability 1. An empty table gives an empty result;
extra columns are ignored. At most 2**32 - 2 different words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C
from quillframe.llm import wordhash as W

FOLDS, HELD_OUT, ORDER = 7, 2, 3
END = W.mix(np.array([0xE0D], np.uint64))[0]
#: Entries that a tally holds at most, and bytes of text for each shard.
TALLY, SHARD_BYTES, LEAST_SHARDS = 1_500_000, 1 << 25, 32
#: Bytes that are scored at once.
SCORE_CHUNK = W.CHUNK // 3


# ---- sorted arrays and blobs ----


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts[order], new)


def merged3(keys: np.ndarray, thirds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of keys in two parts."""
    if not len(keys):
        return keys, thirds, counts
    order = np.lexsort((thirds, keys))
    keys, thirds = keys[order], thirds[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (thirds[1:] != thirds[:-1])])
    return keys[new], thirds[new], np.add.reduceat(counts[order], new)


class Tally:
    def __init__(self, thirds: bool = False):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.least, self.thirds = 0, TALLY, thirds

    def add(self, *entries: np.ndarray) -> None:
        """Keys, third words if the tally has them, counts."""
        self.parts.append((*entries[:-1], entries[-1].astype(np.int64)))
        self.size += len(entries[0])

    def gather(self, *entries: np.ndarray) -> None:
        """``add``, and merges what is held as often as it has doubled."""
        self.add(*entries)
        if self.size > self.least:
            self.settle()
            self.least = max(TALLY, 2 * self.size)

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.empty(0, np.uint64), *([np.empty(0, np.uint32)] * self.thirds), np.empty(0, np.int64)
        out = (merged3 if self.thirds else merged)(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [out], len(out[0])
        return out


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed integers: differences if ascending, bytes of equal weight together."""
    x = np.ascontiguousarray(x, np.uint64)
    if ascending:
        x = np.diff(x, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(blob: bytes, n: int, ascending: bool = False) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    x = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    x = np.ascontiguousarray(x.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


_BLOB = "shard long, n long, keys binary, thirds binary, counts binary"


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    if len(x):
        cut = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)].tolist()
        yield from zip(cut, cut[1:], strict=False)


def blobs(entries: tuple[np.ndarray, ...], shard: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    (keys, *thirds, counts), shard = (x[order] for x in entries), shard[order].astype(np.int64)
    rows = [(int(shard[i]), j - i, pack(keys[i:j], True), pack(thirds[0][i:j]) if thirds else b"", pack(counts[i:j])) for i, j in _cuts(shard)]
    return _batch(rows, ["shard", "n", "keys", "thirds", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def tallied(texts: DataFrame, count: Callable[[], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]], shard: Callable[[], Callable[..., np.ndarray]], thirds: bool = False) -> DataFrame:
    """Blobs of what ``count`` finds in chunks of ``texts`` (one column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, f, deal = Tally(thirds), count(), shard()
        for b in batches:
            data, at = C.text_bytes(b.column(0))
            for i, j in C.chunks(at, W.CHUNK):
                tally.add(*f(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                if tally.size > TALLY:
                    entries = tally.settle()
                    if tally.size > TALLY // 2:
                        yield blobs(entries, deal(*entries[:-1]))
                        tally = Tally(thirds)
        entries = tally.settle()
        if len(entries[0]):
            yield blobs(entries, deal(*entries[:-1]))

    return C.map_batches(texts, run, _BLOB)


def by_shard(df: DataFrame, shards: int, finish: Callable[..., Iterator[pa.RecordBatch]], schema: str, thirds: bool = False) -> DataFrame:
    """``finish`` of each shard's number and merged entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tally = -1, Tally(thirds)
        for b in batches:
            for s, n, keys, third, counts in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "keys", "thirds", "counts")), strict=True):
                if s != held:
                    if held >= 0:
                        yield from finish(held, *tally.settle())
                    held, tally = s, Tally(thirds)
                tally.gather(unpack(keys, n, True), *([unpack(third, n).astype(np.uint32)] if thirds else []), unpack(counts, n))
        if held >= 0:
            yield from finish(held, *tally.settle())

    return C.map_batches(df.repartition(shards, "shard").sortWithinPartitions("shard"), run, schema)


def put_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays of unsigned integers, each from a multiple of 8 bytes on."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.uint64)
    C.put_bytes(uri, [head.tobytes(), *(x for a in arrays for x in (a.tobytes(), bytes(-a.nbytes % 8)))])


def arrays_of(uri: str) -> list[np.ndarray]:
    data, out = C.mapped(uri), []
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    head, at = np.frombuffer(data, np.uint64, 2 * n, 8).astype(np.int64).reshape(n, 2).tolist(), 8 + 16 * n
    for width, size in head:
        out.append(np.frombuffer(data, f"u{width}", size, at))
        at += width * size + -width * size % 8
    return out


def narrow(x: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; 255 stands for one of the rare larger ones, which follow with their places."""
    big = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), big.astype(np.uint64), x[big].astype(np.uint64)]


def widened(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Entries ``at`` of a narrow array."""
    low, places, big = parts
    out = low[at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = big[np.searchsorted(places, at[large].astype(np.uint64))].astype(np.int64)
    return out


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _totals(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return [*(int((counts == k).sum()) for k in range(1, 5)), int((counts >= 3).sum())]


# ---- tokens ----


class Tokens(NamedTuple):
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # whether a token is its text's first


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    w, rows = W.words(data, at, lower=True), len(at) - 1
    total = len(w.hashes) + rows
    hashes, doc = np.full(total, END, np.uint64), np.empty(total, np.int64)
    place = np.arange(len(w.hashes)) + w.doc
    hashes[place] = w.hashes
    ends = np.cumsum(np.bincount(w.doc, minlength=rows)) + np.arange(rows)
    doc[place], doc[ends] = w.doc, np.arange(rows)
    first = np.zeros(total, bool)
    first[np.r_[0, ends[:-1] + 1][:rows]] = True
    return Tokens(hashes, doc, first)


class Layout(NamedTuple):
    """Where a model lies, and what its shards add up to."""

    folder: str
    bits: int  # of the shard number
    offsets: tuple[int, ...]  # of each vocabulary shard's ids; the last is V
    total: int  # N
    rows: int  # training texts

    @property
    def size(self) -> int:
        return self.offsets[-1]

    @property
    def width(self) -> int:
        """Ids of a range of the arrays by id, which has one more for the start."""
        return max(1, -(-(self.size + 1) // (1 << self.bits)))


class Lexicon:
    """The mapped vocabulary."""

    def __init__(self, layout: Layout):
        self.layout, self.held = layout, {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            n = self.layout.offsets[k + 1] - self.layout.offsets[k]
            data = C.mapped(f"{self.layout.folder}/words/{k:06x}") if n else np.empty(0, np.uint8)
            self.held[k] = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n)
        return self.held[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not in training) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes, np.arange(1, 1 << self.layout.bits, dtype=np.uint64) << np.uint64(64 - self.layout.bits))
        edges = np.r_[0, cut, len(hashes)]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            keys, n = self.shard(k)
            if len(keys):
                part = hashes[edges[k] : edges[k + 1]]
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                hit = keys[at] == part
                ids[edges[k] : edges[k + 1]] = np.where(hit, at + self.layout.offsets[k], -1)
                counts[edges[k] : edges[k + 1]] = np.where(hit, n[at].astype(np.int64), 0)
        return ids, counts


def _by_number(x: np.ndarray) -> np.ndarray:
    """The stable order of shard numbers."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def pairs(t: Tokens, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its id and count, its context's id and count. The start's id is V."""
    u, back = np.unique(t.hashes, return_inverse=True)
    ids, counts = lexicon.find(u)
    ids, counts = ids[back], counts[back]
    before, context = np.r_[-1, ids[:-1]], np.r_[0, counts[:-1]]
    return ids, counts, np.where(t.first, lexicon.layout.size, before), np.where(t.first, lexicon.layout.rows, context)


def bigram_shard(keys: np.ndarray, context_counts: np.ndarray, layout: Layout) -> np.ndarray:
    """A context of more than a quarter of a shard's share of tokens is dealt by the whole bigram."""
    hot = context_counts * (4 << layout.bits) > layout.total
    return W.mix(np.where(hot, keys, keys >> np.uint64(32))) >> np.uint64(64 - layout.bits)


def trigram_shard(keys: np.ndarray, thirds: np.ndarray, first_counts: np.ndarray, layout: Layout, hot: np.ndarray) -> np.ndarray:
    """The shard of the first two words, or, if these are hot, one by the whole trigram."""
    spread = W.join2(keys, thirds.astype(np.uint64)) >> np.uint64(64 - layout.bits)
    return np.where(np.isin(keys, hot), spread, bigram_shard(keys, first_counts, layout))


# ---- training ----


class Model(NamedTuple):
    layout: Layout
    discounts: tuple[float, float, float]  # of bigrams
    low: tuple[float, float, float]  # discounts of the numbers of contexts
    types: int  # bigrams
    rest: float  # mass that the numbers of contexts leave to 1 / (V + 1)
    third: tuple[float, float, float] | None = None  # discounts of trigrams; None: order two
    hot: tuple[int, ...] = ()  # contexts of two words whose trigrams lie in many shards, sorted


def discounts(n: list[int]) -> tuple[float, float, float]:
    if not all(n[:4]):
        return 0.5, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _let_go(df: DataFrame) -> None:
    """Has Spark delete the shuffle files of finished queries now; it does so when the JVM collects their plans."""
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()


def train(texts: DataFrame, folder: str | None = None, order: int = 2) -> Model:
    """A model of ``texts`` (column text). ``folder``: where its files go, shared by driver and executors; a new one by default. ``order``: 2 or 3."""
    spark = texts.sparkSession
    folder = folder or C.shared_dir(spark)
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = (max(LEAST_SHARDS, -(-(size[0] or 0) // SHARD_BYTES)) - 1).bit_length()
    shards = 1 << bits

    def words():
        def f(data: np.ndarray, at: np.ndarray):
            return np.unique(tokens(data, at).hashes, return_counts=True)

        return f

    def store(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        C.put_bytes(f"{folder}/words/{shard:06x}", [keys.tobytes(), counts.astype(np.uint64).tobytes()])
        yield _batch([(shard, len(keys), int(counts.sum()))], ["shard", "n", "total"], [pa.int64()] * 3)

    top = np.uint64(64 - bits)
    meta = C.written(by_shard(tallied(texts, words, lambda: lambda keys: keys >> top), shards, store, "shard long, n long, total long"), f"{folder}/meta_words")
    n, total = np.zeros(shards, np.int64), 0
    for r in meta.collect():  # one short row for each shard
        n[r["shard"]] = r["n"]
        total += r["total"]
    layout = Layout(folder, bits, tuple(int(x) for x in np.r_[0, np.cumsum(n)]), total, size[1])
    if layout.size >= 2**32 - 1:
        raise ValueError("too many different words for 32-bit ids")
    if not total:
        return Model(layout, (0.5, 0.75, 0.75), (0.5, 0.75, 0.75), 0, 1.0)

    def bigrams():
        lexicon = _lexicon(layout)

        def f(data: np.ndarray, at: np.ndarray):
            ids, _, before, _ = pairs(tokens(data, at), lexicon)
            return np.unique(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)

        return f

    def deal():
        lexicon = _lexicon(layout)

        def f(keys: np.ndarray) -> np.ndarray:
            return bigram_shard(keys, _first_counts(lexicon, keys), layout)

        return f

    def by_context(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of each first word, how many of its bigrams count one, two, more, and the sum."""
        context, cut = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
        for k, x in enumerate((counts == 1, counts == 2, counts >= 3, counts)):
            yield from ranged(fields[k + 1], context, np.add.reduceat(x.astype(np.int64), cut))

    def store_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        put_arrays(f"{folder}/pairs/{shard:06x}", [keys, *narrow(counts)])
        yield _batch([("meta", shard, len(keys), pack(np.array(_totals(counts))), b"")], names, kinds)
        yield from ranged("cont", *np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True))
        if order == 2:
            yield from by_context(keys, counts)
        else:
            hot = keys[counts * (4 << bits) > total]
            yield _batch([("hot", shard, len(hot), pack(hot, True), b""), ("after", shard, 0, b"", b"")], names, kinds)

    names, kinds = ["kind", "shard", "n", "keys", "counts"], [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def ranged(kind: str, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries that aren't zero, cut into ranges of ids."""
        some = counts > 0
        ids, counts = ids[some], counts[some]
        if len(ids):
            part = ids // layout.width
            yield _batch([(kind, int(part[i]), j - i, pack(ids[i:j], True), pack(counts[i:j])) for i, j in _cuts(part)], names, kinds)

    fields, some = ["cont", "ctx0", "ctx1", "ctx2", "sum"], "kind string, shard long, n long, keys binary, counts binary"
    got = C.written(by_shard(tallied(texts, bigrams, deal), shards, store_pairs, some), f"{folder}/meta_pairs")

    def totals(df: DataFrame) -> tuple[int, list[int]]:
        rows = df.filter("kind = 'meta'").select("n", "keys").collect()  # one short row for each shard
        return sum(r["n"] for r in rows), sum((unpack(r["keys"], 5).astype(np.int64) for r in rows), np.zeros(5, np.int64)).tolist()

    types, of = totals(got)
    third, hot = None, np.empty(0, np.uint64)
    if order == 3:
        _let_go(texts)
        hot = np.sort(np.concatenate([hot, *(unpack(r["keys"], r["n"], True) for r in got.filter("kind = 'hot' and n > 0").collect())]))  # fewer than four for each shard

        def trigrams():
            lexicon = _lexicon(layout)

            def f(data: np.ndarray, at: np.ndarray):
                t = tokens(data, at)
                ids, _, before, _ = pairs(t, lexicon)
                key = before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)
                later = np.flatnonzero(~t.first)
                return key[later - 1], ids[later].astype(np.uint32), np.ones(len(later), np.int64)

            return f

        def deal3():
            lexicon = _lexicon(layout)

            def f(keys: np.ndarray, thirds: np.ndarray) -> np.ndarray:
                return trigram_shard(keys, thirds, _first_counts(lexicon, keys), layout, hot)

            return f

        def to_pairs(kind: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Entries of bigrams, cut into the shards of these."""
            to = bigram_shard(keys, _first_counts(_lexicon(layout), keys), layout).astype(np.int64)
            by = np.argsort(to, kind="stable")
            keys, counts, to = keys[by], counts[by], to[by]
            for i, j in _cuts(to):
                yield _batch([(kind, int(to[i]), j - i, pack(keys[i:j], True), pack(counts[i:j]))], names, kinds)

        def store_trigrams(shard: int, keys: np.ndarray, thirds: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield _batch([("meta", shard, len(keys), pack(np.array(_totals(counts))), b"")], names, kinds)
            last = np.argsort(np.isin(keys, hot), kind="stable")  # hot contexts after the others
            keys, thirds, counts = keys[last], thirds[last], counts[last]
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            context, size = keys[cut], np.diff(np.r_[cut, len(keys)])
            own = ~np.isin(context, hot)
            held = _arrays(f"{folder}/pairs/{shard:06x}") if own.any() else None
            n = len(held[0]) if held else 0
            place = np.empty(len(context), np.int64)
            if held:
                place[own] = np.searchsorted(held[0], context[own])
            place[~own] = n + np.arange((~own).sum())
            wide = lambda x: np.bincount(place, x, minlength=n + int((~own).sum())).astype(np.int64)
            per = [np.add.reduceat(x.astype(np.int64), cut) for x in (counts == 1, counts == 2, counts >= 3)]
            starts = np.r_[0, np.cumsum(wide(size))].astype(np.uint32)
            put_arrays(f"{folder}/trigrams/{shard:06x}", [np.array([n], np.uint64), context[~own], starts, *narrow(wide(per[1])), *narrow(wide(per[2])), thirds, *narrow(counts)])
            for k in range(3):
                yield from to_pairs(f"hot{k}", context[~own], per[k][~own])
            yield from to_pairs("after", *np.unique((keys & np.uint64(0xFFFFFFFF)) << np.uint64(32) | thirds.astype(np.uint64), return_counts=True))

        got3 = C.written(by_shard(tallied(texts, trigrams, deal3, True), shards, store_trigrams, some, True), f"{folder}/meta_trigrams")
        third = discounts(totals(got3)[1])
        _let_go(texts)

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def ended(shard: int, tallies: dict[str, Tally]) -> Iterator[pa.RecordBatch]:
                keys, *own = _arrays(f"{folder}/pairs/{shard:06x}")
                found, n = tallies["after"].settle()
                a = np.zeros(len(keys), np.int64)
                a[np.searchsorted(keys, found)] = n
                start = np.flatnonzero(keys >> np.uint64(32) == layout.size)
                a[start] = widened(own, start)
                many = [tallies[f"hot{k}"].settle() for k in range(3)]
                names3 = np.unique(np.concatenate([k for k, _ in many]))
                put_arrays(f"{folder}/after/{shard:06x}", [*narrow(a), names3, *(x.astype(np.uint64) for _, x in many)])
                yield _batch([("meta", shard, len(keys), pack(np.array(_totals(a))), b"")], names, kinds)
                yield from by_context(keys, a)

            held, tallies = -1, {}
            for b in batches:
                for kind, s, n, keys, counts in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                    if s != held:
                        if held >= 0:
                            yield from ended(held, tallies)
                        held, tallies = s, {k: Tally() for k in ("after", "hot0", "hot1", "hot2")}
                    tallies[kind].gather(unpack(keys, n, True), unpack(counts, n))
            if held >= 0:
                yield from ended(held, tallies)

        moved = got.filter("kind = 'after'").unionByName(got3.filter("kind <> 'meta'"))
        got2 = C.written(C.map_batches(moved.repartition(shards, "shard").sortWithinPartitions("shard"), lower, some), f"{folder}/meta_after")
        of = totals(got2)[1]
        got = got.filter("kind = 'cont'").unionByName(got2)

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = -1, np.zeros((5, layout.width), np.uint32)

        def ended() -> Iterator[pa.RecordBatch]:
            C.put_bytes(f"{folder}/ids/{held:06x}", [table.tobytes()])
            yield _batch([(held, pack(np.array(_totals(table[0]))))], ["shard", "totals"], [pa.int64(), pa.binary()])

        for b in batches:
            for kind, s, n, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "n", "keys", "counts")), strict=True):
                if s != held:
                    if held >= 0:
                        yield from ended()
                    held, table = s, np.zeros((5, layout.width), np.uint32)
                table[fields.index(kind)][unpack(keys, n, True).astype(np.int64) - s * layout.width] += unpack(counts, n).astype(np.uint32)
        if held >= 0:
            yield from ended()

    low = C.map_batches(got.filter("kind <> 'meta'").repartition(shards, "shard").sortWithinPartitions("shard"), by_id, "shard long, totals binary")
    low_of = np.zeros(5, np.int64)
    for r in C.written(low, f"{folder}/meta_ids").collect():
        low_of += unpack(r["totals"], 5).astype(np.int64)
    d = discounts(low_of.tolist())
    return Model(layout, discounts(of), d, types, float(d[0] * low_of[0] + d[1] * low_of[1] + d[2] * low_of[4]) / types, third, tuple(hot.tolist()))


def _arrays(uri: str) -> list[np.ndarray] | None:
    try:
        return arrays_of(uri)
    except FileNotFoundError:  # nothing fell there
        return None


@lru_cache(2)
def _lexicon(layout: Layout) -> Lexicon:
    return Lexicon(layout)


def _counts_of(lexicon: Lexicon, ids: np.ndarray) -> np.ndarray:
    """Counts of ids; the start's is the number of texts."""
    lay = lexicon.layout
    u, back = np.unique(ids, return_inverse=True)
    out = np.zeros(len(u), np.int64)
    cut = np.searchsorted(u, lay.offsets)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        out[cut[k] : cut[k + 1]] = lexicon.shard(k)[1][u[cut[k] : cut[k + 1]] - lay.offsets[k]]
    out[u == lay.size] = lay.rows
    return out[back]


def _first_counts(lexicon: Lexicon, keys: np.ndarray) -> np.ndarray:
    """Counts of the first words of bigrams."""
    return _counts_of(lexicon, (keys >> np.uint64(32)).astype(np.int64))


# ---- scoring ----


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon, self.held = model, _lexicon(model.layout), {}
        self.d, self.low = np.array([0, *model.discounts]), np.array([0, *model.low])
        self.third, self.hot = np.array([0, *(model.third or (0, 0, 0))]), np.array(model.hot, np.uint64)

    def _file(self, kind: str, k: int) -> list[np.ndarray] | None:
        if (kind, k) not in self.held:
            self.held[kind, k] = _arrays(f"{self.model.layout.folder}/{kind}/{k:06x}")
        return self.held[kind, k]

    def _by_id(self, ids: np.ndarray) -> np.ndarray:
        """The five arrays by id, for sorted distinct ids."""
        lay, out = self.model.layout, np.zeros((5, len(ids)), np.int64)
        cut = np.searchsorted(ids, np.arange((1 << lay.bits) + 1) * lay.width)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if ("i", k) not in self.held:
                try:
                    self.held["i", k] = np.frombuffer(C.mapped(f"{lay.folder}/ids/{k:06x}"), np.uint32).reshape(5, lay.width)
                except FileNotFoundError:
                    self.held["i", k] = np.zeros((5, lay.width), np.uint32)
            out[:, cut[k] : cut[k + 1]] = self.held["i", k][:, ids[cut[k] : cut[k + 1]] - k * lay.width]
        return out

    def _pair_counts(self, before: np.ndarray, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of every token's bigram, by rows: its count, the number of words before it (order three), its shard and its place there (-1: never seen)."""
        lay, out = self.model.layout, np.zeros((4, len(ids)), np.int64)
        out[3] = -1
        known = np.flatnonzero((before >= 0) & (ids >= 0))
        key = before[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64)
        u, first, back = np.unique(key, return_index=True, return_inverse=True)
        shard = bigram_shard(u, context[known][first], lay).astype(np.int64)
        got, order = np.zeros((4, len(u)), np.int64), _by_number(shard)
        got[2], got[3] = shard, -1
        for i, j in _cuts(shard[order]):
            mine = order[i:j]  # ascending keys
            k = int(shard[mine[0]])
            if (held := self._file("pairs", k)) is not None:
                at = np.minimum(np.searchsorted(held[0], u[mine]), len(held[0]) - 1)
                hit = held[0][at] == u[mine]
                mine, at = mine[hit], at[hit]
                got[0, mine], got[3, mine] = widened(held[1:], at), at
                if self.model.third:
                    got[1, mine] = widened(self._file("after", k)[:3], at)
        out[:, known] = got[:, back]
        return out

    def _trigrams(self, keys: np.ndarray, shard: np.ndarray, place: np.ndarray, thirds: np.ndarray) -> np.ndarray:
        """Of trigrams whose first two words lie in ``place`` of ``shard``, by rows: count, and how many of their context's trigrams occur once, twice, more often."""
        lay, out = self.model.layout, np.zeros((4, len(keys)), np.int64)
        hot = np.isin(keys, self.hot)
        where = np.where(hot, W.join2(keys, thirds.astype(np.uint64)) >> np.uint64(64 - lay.bits), shard.astype(np.uint64)).astype(np.int64)
        order = _by_number(where)
        for i, j in _cuts(where[order]):
            mine = order[i:j]
            if (held := self._file("trigrams", int(where[mine[0]]))) is None:
                continue
            (n,), names, starts, twice, more, words, counts = *held[:3], held[3:6], held[6:9], held[9], held[10:13]
            at = place[mine].copy()
            if (h := hot[mine]).any():
                x = keys[mine[h]]
                found = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
                at[h] = np.where(names[found] == x, int(n) + found, -1) if len(names) else -1
            mine, at = mine[at >= 0], at[at >= 0]
            low, high = starts[at].astype(np.int64), starts[at + 1].astype(np.int64)
            out[2, mine], out[3, mine] = widened(twice, at), widened(more, at)
            out[1, mine] = high - low - out[2, mine] - out[3, mine]
            end, w = high.copy(), thirds[mine]
            left = np.flatnonzero(low < high)
            while len(left):  # the first third word that isn't less
                a, b = low[left], high[left]
                mid = (a + b) // 2
                less = words[mid] < w[left]
                low[left], high[left] = a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
                left = left[a < b]
            hit = np.flatnonzero(low < end)
            hit = hit[words[low[hit]] == w[hit]]
            out[0, mine[hit]] = widened(counts, low[hit])
        if hot.any():  # their contexts' numbers are sums over shards, kept with the bigram
            mine = np.flatnonzero(hot)
            mine = mine[np.argsort(shard[mine], kind="stable")]
            for i, j in _cuts(shard[mine]):
                part = mine[i:j]
                *_, names, once, twice, more = self._file("after", int(shard[part[0]]))
                at = np.searchsorted(names, keys[part])
                out[1:, part] = np.stack([x[at] for x in (once, twice, more)]).astype(np.int64)
        return out

    @staticmethod
    def _mixed(d: np.ndarray, c: np.ndarray, over: np.ndarray, numbers, lower: np.ndarray) -> np.ndarray:
        """Discounted counts over their context's, and what that leaves to the lower order."""
        over = np.maximum(over, 1)
        return np.maximum(c - d[np.minimum(c, 3)], 0) / over + (d[1] * numbers[0] + d[2] * numbers[1] + d[3] * numbers[2]) / over * lower

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: tokens, known tokens, base score, score."""
        m, lay, rows = self.model, self.model.layout, len(at) - 1
        t = tokens(data, at)
        u, back = np.unique(t.hashes, return_inverse=True)
        own, of_own = self.lexicon.find(u)  # ascending ids, as the hashes ascend
        ids, counts = own[back], of_own[back]
        # the start's id is V, its place here the one after the last
        prior = np.where(t.first, len(u), np.r_[0, back[:-1]])
        before, context = np.r_[own, lay.size][prior], np.r_[of_own, lay.rows][prior]
        base = np.log10((counts + 1) / (lay.total + lay.size + 1))
        p = np.full(len(ids), 1 / (lay.size + 1))
        if m.types:
            table, some = np.zeros((5, len(u) + 1), np.int64), np.flatnonzero(np.r_[own >= 0, True])
            table[:, some] = self._by_id(np.r_[own, lay.size][some])
            cont = table[0][back]
            p = np.maximum(cont - self.low[np.minimum(cont, 3)], 0) / m.types + m.rest / (lay.size + 1)
            numbers = table[1:, prior]
            raw, after, shard, place = self._pair_counts(before, ids, context)
            c, over = (after, numbers[3]) if m.third else (raw, context)
            p = np.where((before >= 0) & (over > 0), self._mixed(self.d, c, over, numbers[:3], p), p)
            if m.third:
                of = np.flatnonzero(~t.first)
                of = of[place[of - 1] >= 0]  # the two words before were seen together
                key = before[of - 1].astype(np.uint64) << np.uint64(32) | ids[of - 1].astype(np.uint64)
                # a third word never seen is no word's id: V
                word = np.where(ids[of] < 0, lay.size, ids[of]).astype(np.uint32)
                c, *numbers = self._trigrams(key, shard[of - 1], place[of - 1], word)
                p[of] = self._mixed(self.third, c, raw[of - 1], numbers, p[of])
        per = lambda x: np.bincount(t.doc, x, minlength=rows)
        return np.bincount(t.doc, minlength=rows), per(counts > 0).astype(np.int64), per(base), per(np.log10(p))


def scored(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def make():
        scorer = Scorer(model)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(2))
            parts = [scorer.score(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in C.chunks(at, SCORE_CHUNK)]
            n, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            train_n = np.full(b.num_rows, model.layout.total, np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in (n, known, train_n, base, score, 10 ** np.minimum(-score / n, 300)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        return f

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(thin, make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs.filter(C.fold(F.col("doc_id"), FOLDS) != HELD_OUT), order=ORDER))
