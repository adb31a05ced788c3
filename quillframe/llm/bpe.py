"""Byte-level BPE by a monoid tree reduction.

An element is a stretch of text with its token ids; the whole text is the product of its leaves. A long text is encoded by halves,
recursively; two neighbours are joined by encoding again only a window around their border. The window grows on both sides to the
nearest change from a non-space to a space character. Every alternative of the pattern takes spaces only before other
characters or alone, so a match never runs across such a change, whatever stands around it: the tokens outside the window are
those of the whole text, and the tokens inside are encoded by themselves. Where a side has no such change, the window takes all of it.
Decoding concatenates the tokens' bytes, again by halves.

Texts of up to ``LEAF`` characters are one leaf, encoded by the library. Ids, never text, travel between the functions.

Nulls: a null text is empty: no tokens, and the digests of nothing. A null id passes through. Repeated rows give repeated rows, an
empty table an empty one; the library breaks ties of merges by rank. A text above ``LEAF`` characters is encoded by halves, however long.
Extra columns of any name are kept by ``encoded`` (but one named as its result) and ignored by ``digests``.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C

LEAF = 1 << 12
#: Characters that the first window looks at on either side.
LOOK = 64
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A change from a character that is surely no space to one that surely is, whichever library decides.
_BORDER = regex.compile(r"[^\s\x1c-\x1f](?=[ \t\n\r])")


class Codec:
    """The library's encoding and what decoding needs, read once a worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.decimal = [b"%d" % i for i in range(len(self.token))]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self._leaf(text)
        middle = len(text) // 2
        return self.join(text[:middle], self.encode(text[:middle], leaf), text[middle:], self.encode(text[middle:], leaf))

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """Tokens of ``a + b`` from those of each."""
        if not a or not b:
            return left + right
        start, look = 0, LOOK
        while True:  # the last border of a, in ever larger tails
            tail = max(0, len(a) - look)
            if found := list(_BORDER.finditer(a, tail)):
                start = found[-1].end()
                break
            if not tail:
                break
            look *= 4
        stop, look = len(b), LOOK
        while True:  # the first of b; its own first character may follow a space of a, so a border needs both sides in b
            if found := _BORDER.search(b, 0, min(len(b), look + 1)):
                stop = found.end()
                break
            if look >= len(b):
                break
            look *= 4
        keep = self._keep(left, len(a[start:].encode()))
        skip = len(right) - self._keep(right[::-1], len(b[:stop].encode()))
        return left[:keep] + self.encode(a[start:] + b[:stop], max(LEAF, len(a) - start + stop)) + right[skip:]

    def _keep(self, ids: list[int], n: int) -> int:
        """How many ids are left when those at the end that spell ``n`` bytes go."""
        k, token = len(ids), self.token
        while n > 0:
            k -= 1
            n -= len(token[ids[k]])
        if n:
            raise AssertionError("a token runs across a border")
        return k

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join([self.token[i] for i in ids])
        return self.decode(ids[: len(ids) // 2], leaf) + self.decode(ids[len(ids) // 2 :], leaf)


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def public(vocabulary: str = VOCABULARY) -> tuple[str, str]:
    """Path and pattern of a vocabulary of the public tokenizers; a path is an argument wherever one is used."""
    import public_tokenizers as P

    return P.path(vocabulary), P.PATTERN


def _digest_row(k: Codec, text: str) -> tuple[int, str, str]:
    ids = k.encode(text)
    return len(ids), hashlib.sha256(b" ".join([k.decimal[i] for i in ids])).hexdigest(), hashlib.sha256(k.decode(ids)).hexdigest()


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space), decoded_sha256."""

    def make():
        k = codec(*((path, pattern) if path else public()))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back = zip(*(_digest_row(k, x) for x in C.texts(b.column(1))), strict=True)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(thin, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, column: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with its texts' token ids in ``column``."""
    C.ship(docs.sparkSession)

    def ids(text: pa.Array) -> pa.Array:
        k = codec(*((path, pattern) if path else public()))
        return pa.array([np.array(k.encode(x), np.int32) for x in C.texts(text)], pa.list_(pa.int32()))

    ids.__annotations__ = {"text": pa.Array, "return": pa.Array}  # not as texts: Spark reads them
    made = F.arrow_udf(ids, "array<int>")(F.col("text").cast("string"))
    return docs.select(*(C.name(c) for c in docs.columns if c != column), made.alias(column))


def decoded(docs: DataFrame, column: str = "ids", to: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the texts that ``column`` spells, as bytes where they aren't UTF-8."""

    def make():
        k = codec(*((path, pattern) if path else public()))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([k.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", to])

        return f

    return C.arrow_map(docs.select("doc_id", column), make, f"doc_id long, `{to}` binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
