"""Token counts by a two-tier lookup on the map side: no text or pre-token is shuffled to be counted.

The tokenizer turns spaces into its own mark and puts one before the text. No piece of its vocabulary goes on past such a mark, so a
text's tokens are those of its pre-tokens: a run of spaces with the characters up to the next run. The first tier is a
compact hash table of the token counts of frequent pre-tokens, broadcast to every task. It is found over the whole corpus: each
batch sends those of under ``SHORT`` bytes that it has twice or more often, the ``BATCH_TOP`` commonest at most, and the ``FREQUENT`` with the
largest totals stay; what it holds only decides how fast a text is counted. The second tier encodes what the first misses, once a worker, and keeps the
counts in a cache of bounded size. A vocabulary that has a piece across a mark is refused; ``whole`` counts with it
text by text.

Nulls: a null text is empty: 0 bytes, 0 tokens. A null id passes through. Repeated rows give repeated rows, an empty table
an empty one; extra columns are ignored. Of pre-tokens that are equally common the smaller hashes go into the table, which changes no
count. A text of any length is counted whole. Pre-tokens are told by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C
from quillframe.llm import wordhash as W

VOCABULARY = "piece_bpe_32k.model"
FREQUENT, BATCH_TOP, CACHE = 1 << 16, 4_096, 200_000
#: Bytes of pre-tokens from which neither the table nor a cache keeps them.
SHORT = 64
LIMIT = 4_096
_MARK = "▁".encode()


@lru_cache(4)
def library(path: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in found.id_to_piece(i).lstrip("▁") for i in range(found.get_piece_size())):
        raise ValueError(f"{path} has a piece that goes on past a space")
    return found


def public(vocabulary: str = VOCABULARY) -> str:
    import public_tokenizers as P

    return P.path(vocabulary)


def encoded_lengths(path: str, pieces: list[str]) -> list[int]:
    """Token counts of pre-tokens without their first space, which the library puts back; a lone space is the mark itself, one token."""
    return [len(ids) if piece else 1 for piece, ids in zip(pieces, library(path).encode(pieces, num_threads=1), strict=True)] if pieces else []


def pretokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before every text that isn't empty, and each pre-token's hash, row, start and end."""
    text = data.tobytes()
    if _MARK in text:  # the mark itself reads as a space
        rows = [text[at[i] : at[i + 1]].replace(_MARK, b" ") for i in range(len(at) - 1)]
    else:
        rows = [text[at[i] : at[i + 1]] for i in range(len(at) - 1)]
    rows = [b" " + x if x else b"" for x in rows]
    data = np.frombuffer(b"".join(rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    if not len(data):
        return data, np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(data)]
    return data, W.span_hashes(data, starts, ends), np.searchsorted(at[1:], starts, "right"), starts, ends


class Table:
    """Open addressing over 64-bit hashes, a quarter full at most; looks up a whole array at once. Hash 0 marks a free slot and is never found."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(hashes) - 1).bit_length())
        self.keys, self.values, self.mask, self.probes = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.uint64(size - 1), 1
        hashes, first = np.unique(hashes, return_index=True)
        values = values[first]
        left = np.flatnonzero(hashes)
        for probe in range(size):
            if not len(left):
                break
            slot = (hashes[left] + np.uint64(probe)) & self.mask
            free = self.keys[slot] == 0
            got, one = np.unique(slot[free], return_index=True)
            take = left[free][one]
            self.keys[got], self.values[got] = hashes[take], values[take]
            left = np.setdiff1d(left, take, assume_unique=True)
            self.probes = probe + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values, -1 where there's none."""
        out, left = np.full(len(hashes), -1, np.int32), np.flatnonzero(hashes)
        for probe in range(self.probes):
            slot = (hashes[left] + np.uint64(probe)) & self.mask
            hit = self.keys[slot] == hashes[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (self.keys[slot] != 0)]
            if not len(left):
                break
        return out


def frequent(docs: DataFrame, path: str, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the commonest pre-tokens of all texts."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(0))
            held: dict[int, list] = {}
            for i, j in C.chunks(at, W.CHUNK):
                part, h, _, s, e = pretokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                h, s, e = (x[e - s < SHORT] for x in (h, s, e))
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                top = np.argsort(-n, kind="stable")[:BATCH_TOP]
                top = top[n[top] > 1]
                for k in top.tolist():
                    if (x := held.get(u[k])) is None:
                        held[u[k]] = [int(n[k]), part[s[first[k]] : e[first[k]]].tobytes()]
                    else:
                        x[0] += int(n[k])
            rows = sorted(((k, *v) for k, v in held.items()), key=lambda x: (-x[1], x[0]))[:BATCH_TOP]
            return pa.RecordBatch.from_arrays([pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["h", "n", "piece"])

        return f

    found = C.arrow_map(docs.select(F.col("text").cast("string").alias("text")), make, "h long, n long, piece binary")
    rows = found.groupBy("h").agg(F.sum("n").alias("n"), F.min("piece").alias("piece")).orderBy(F.desc("n"), "h").limit(most).select("h", "piece").collect()
    counts = encoded_lengths(path, [bytes(r["piece"])[1:].decode() for r in rows])
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array(counts, np.int32)


class Counter:
    """Token counts of many texts, with the table of the first tier and a worker's cache for the rest."""

    def __init__(self, path: str, table: Table):
        self.path, self.table, self.cache = path, table, {}

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        data, h, doc, s, e = pretokens(data, at)
        n = self.table.find(h)
        miss = np.flatnonzero(n < 0)
        if len(miss):
            u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = [self.cache.get(x, -1) for x in u.tolist()]
            new = [k for k, x in enumerate(got) if x < 0]
            if new:
                raw = data.tobytes()
                pieces = [raw[s[miss[first[k]]] + 1 : e[miss[first[k]]]].decode() for k in new]
                if len(self.cache) + len(new) > CACHE:
                    self.cache.clear()
                for k, piece, n_ids in zip(new, pieces, encoded_lengths(self.path, pieces), strict=True):
                    got[k] = n_ids
                    if len(piece) < SHORT:
                        self.cache[int(u[k])] = got[k]
            n[miss] = np.array(got, np.int32)[back]
        return np.bincount(doc, n, minlength=len(at) - 1).astype(np.int64)


def counted(docs: DataFrame, limit: int = LIMIT, path: str | None = None, most: int = FREQUENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    sc = docs.sparkSession.sparkContext
    tier = sc.broadcast(frequent(docs, path or public(), most))  # at most FREQUENT hashes and counts

    def make():
        c = Counter(path or public(), Table(*tier.value))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = C.text_bytes(b.column(1))
            n = np.concatenate([c.count(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in C.chunks(at, W.CHUNK)])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(thin, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def whole(text: str, path: str) -> int:
    """The library's own count of one text."""
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text, num_threads=1))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted(C.table(spark, sf_dir, "documents"))
