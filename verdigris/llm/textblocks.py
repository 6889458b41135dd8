"""Vectorised word and n-gram hashing over Arrow text batches.

A block is a run of whole documents of one Arrow batch: their UTF-8 bytes in
one numpy array with document offsets. Everything here is local to a task;
Spark deals out the blocks and shuffles what is made of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes of words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing, and `[^\x20\x09-\x0D]`.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False
SPACED = np.ones(256, bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE)
    down = np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    return _powers(1 << max(n - 1, 1).bit_length())


class Block:
    """Documents lo..hi of a batch: `data` bytes, `offsets` (one more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.data, self.offsets, self.lo, self.hi = data, offsets, lo, hi

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def words(self, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and 64-bit hash of each word, and for each document
        the index of its first word (one more than documents)."""
        b = self.data
        if lower:
            b = LOWER[b]
        is_word = word[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(b), bool)
        before[:1] = False
        before[1:] = is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.empty(len(b), bool)
        after[-1:] = False
        after[:-1] = is_word[1:]
        ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        up, down = powers(len(b) + 1)
        run = np.empty(len(b) + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64, out=run[1:])
        hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)
        return starts, ends, hashes, np.searchsorted(starts, self.offsets)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about `most` bytes, of whole documents; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, hi)
        lo = hi


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, for the words that have n in their
    document, with the word's index."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[k : m + k]
    ok = np.ones(m, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def doc_of(index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The document, within the block, of each word index."""
    return np.searchsorted(first, index, "right") - 1
