"""Words of many texts at once as 64-bit hashes, by numpy over the bytes: no Python object for a word.

A span's hash is a chain over its 8-byte pieces, h = mix(h ^ piece), that starts from its length; the last piece is padded by zeros. Every
step is a bijection that spreads every bit, so texts of one structure don't collide whatever their letters. Spans above ``CHAIN``
bytes, which are rare, are hashed by XXH64 one by one. Equal spans have equal hashes in every process.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are worked on at once; a longer text is taken whole.
CHUNK = 1 << 21
#: Bytes of the longest span that is hashed by pieces.
CHAIN = 256
_SEED = np.uint64(0x9E3779B97F4A7C15)
_BITS = [np.uint64(k) for k in (27, 30, 31)]
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Of a piece with k bytes left in its span, those that count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _BITS[1])) * _FIRST
    h = (h ^ (h >> _BITS[0])) * _SECOND
    return h ^ (h >> _BITS[2])


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b) + np.uint64(1))


def _pieces(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans. A span's hash doesn't depend on where it lies."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at, size = _pieces(data), ends - starts
    h = size.astype(np.uint64) * _SEED + _SEED
    # nearly all words have one piece or two
    h = mix(h ^ (at[starts] & _MASK[np.minimum(size, 8)]))
    left = np.flatnonzero((size > 8) & (size <= CHAIN))
    done = 8
    while len(left):
        h[left] = mix(h[left] ^ (at[starts[left] + done] & _MASK[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > CHAIN).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], 7)
    return h


class Words(NamedTuple):
    hashes: np.ndarray
    doc: np.ndarray  # row of each word
    starts: np.ndarray
    ends: np.ndarray


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that lie within rows with offsets ``at``."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = at[:-1][at[:-1] < at[1:]]
    first[begin] = inside[begin]
    stop = at[1:][at[:-1] < at[1:]] - 1
    last[stop] = inside[stop]
    assert n == 0 or at[-1] == n
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[at[i]:at[i + 1]]``; ``at`` starts at 0 and ends at ``len(data)``."""
    starts, ends = edges(~SPACE[data], at)
    return Words(span_hashes(LOWER[data] if lower else data, starts, ends), np.searchsorted(at[1:], starts, "right"), starts, ends)


def per_row(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``weights`` (one for each byte) in every row."""
    if len(at) == 2:  # a long text is a chunk of its own
        return np.array([weights.sum(dtype=np.int64)])
    total = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
