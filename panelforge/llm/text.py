"""Whole texts of an Arrow batch as numpy arrays: words, word hashes, windows.

Work goes slice by slice (about ``SLICE`` bytes of text, always whole documents), so memory follows
the slice or the longest document, never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = (1 << 19) - 64
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE, WORD_BASE = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(int(base), 1 << max(18, int(n).bit_length()))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b), their UTF-8 bytes and offsets into them. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, where, what = texts.buffers()  # read in place: a batch is never copied whole
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    if texts.null_count and np.diff(offsets)[texts.is_null().to_numpy(zero_copy_only=False)].any():
        yield from slices(pc.fill_null(texts, ""), limit)
        return
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
    pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word (maximal run of bytes that aren't separators)."""
    inside = ~separator[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums over the bytes."""
    up, down = powers(BASE, len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[: len(data)], dtype=U64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words (document borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(WORD_BASE, len(words) + 1)
    prefix = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], dtype=U64, out=prefix[1:])
    return mix((prefix[k:] - prefix[:n]) * down[:n] + U64(k))


def counts_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document (sorted within it) and how many each has.

    Words are lower-cased (A-Z). With fewer than k words the whole sequence is the one shingle.
    """
    data = LOWER[data]
    starts, ends, doc = spans(data, offsets)
    n_docs = len(offsets) - 1
    words, n_words = word_hashes(data, starts, ends), counts_of(doc, n_docs)
    at = np.concatenate([[0], np.cumsum(n_words)])
    every = window_hashes(words, k)
    left = at[doc + 1] - np.arange(len(doc))  # words from here to the document's end
    whole = left[: len(every)] >= k
    values, owner = every[whole], doc[: len(every)][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        own = np.array([mix(window_hashes(words[at[d] : at[d + 1]], int(n_words[d])))[0] for d in short], U64)
        values, owner = np.concatenate([values, own]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])
    for d in range(n_docs):
        values[edge[d] : edge[d + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=n_docs)
