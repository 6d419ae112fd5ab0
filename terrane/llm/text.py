"""Columnar text kernels: words, word hashes and word-window hashes of a whole Arrow batch at once.

Words are maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). A null text has no words.
All hashes are 64-bit polynomials modulo 2**64 with a final mix; callers that need certainty carry two of them
(different ``base``) or verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the two independent hash families.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text whose hashes are computed in one numpy pass; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and the n + 1 offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most limit bytes, or one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and the n + 1 word offsets of the documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(n, bool)
    before[1:], before[0] = inside[:-1], False
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[:-1], after[-1] = inside[1:], False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (public-domain splitmix64 finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values times rising powers: slices of it are hashes of slices."""
        up, _ = self.upto(len(values))
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.upto(len(sums))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    return powers.slices(powers.sums(data.astype(U) + U(1)), starts, ends)


def windows(hashes: np.ndarray, word_offsets: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of size words that lie in one document, and their hashes."""
    counts = np.diff(word_offsets)
    last = np.repeat(word_offsets[1:], counts)
    first = np.flatnonzero(np.arange(len(hashes)) + size <= last)
    return first, powers.slices(powers.sums(hashes), first, first + size)


def shingle_sets(hashes: np.ndarray, word_offsets: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every document, sorted, and the n + 1 offsets of the documents.

    A document with fewer than size words, but one at least, has its whole word sequence as its only shingle.
    """
    first, h = windows(hashes, word_offsets, size, powers)
    counts = np.diff(word_offsets)
    doc = np.searchsorted(word_offsets, first, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = powers.sums(hashes)
        h = np.concatenate([h, powers.slices(sums, word_offsets[short], word_offsets[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))
