"""Word hashing over Arrow string batches with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All of these
separators are ASCII, so working on UTF-8 bytes gives the same words as working
on code points.  A word's hash is a polynomial over its bytes, taken as a
difference of two prefix sums modulo 2**64; a window of k words is hashed the
same way over word hashes.  Both are O(1) for each word, whatever k is.  Sums are
taken over a chunk at a time, so a long text needs some 10 bytes a byte and 50 a word, and the powers of the
bases are no more than a chunk has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and words, hashed at once: it bounds memory, and arrays stay in cache.
CHUNK_BYTES = 1 << 20
CHUNK_WORDS = 1 << 18

_U = np.uint64


def _generator(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for words of letters and digits only: all other ASCII.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = _generator(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_BYTES_BASE = _Powers(0x9E3779B97F4A7C15)
_WORDS_BASE = _Powers(0xD1342543DE82EF95)
_SECOND_BASE = _Powers(0xAF251AF3B0F025B5)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of a run of texts: byte spans, 64-bit hashes (made when they are asked for), and the first word of each text."""

    __slots__ = ("_hashes", "_table", "bytes", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray = _SEPARATOR):
        """data: the texts' bytes, one after the other; offsets: where each begins, and the end; separators: by byte."""
        base = int(offsets[0]) if len(offsets) else 0
        offsets = offsets.astype(np.int64) - base
        data = data[base : base + int(offsets[-1])]
        n = len(data)
        self.bytes = data
        word = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True  # a word never runs from one text into the next
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~word[:-1]
            after[:-1] = ~word[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._table, self._hashes = _BYTE_LOWER if lower else _BYTE, None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self._hashed(self._table)
        return self._hashes

    def _hashed(self, table: np.ndarray) -> np.ndarray:
        n, size = len(self.bytes), min(CHUNK_BYTES, max(1, len(self.bytes)))
        up, down = _BYTES_BASE.upto(size + 1)
        below, above, inverse = (np.empty(len(self.starts), dtype=np.uint64) for _ in range(3))
        # the sum of all before the chunk, and the base's powers where it begins
        total, power, undo = _U(0), 1, 1
        i = j = 0
        with np.errstate(over="ignore"):
            for a in range(0, n, size):
                b = min(a + size, n)
                sums = np.zeros(b - a + 1, dtype=np.uint64)
                np.cumsum(table[self.bytes[a:b]] * up[: b - a], out=sums[1:])
                sums = total + sums * _U(power)
                to, end = np.searchsorted(self.starts, b), np.searchsorted(self.ends, b, side="right")
                at = self.starts[i:to] - a
                below[i:to], inverse[i:to] = sums[at], down[at] * _U(undo)
                above[j:end] = sums[self.ends[j:end] - a]
                i, j, total = to, end, sums[-1]
                power, undo = power * pow(_BYTES_BASE.base, size, 2**64) % 2**64, undo * pow(_BYTES_BASE.inverse, size, 2**64) % 2**64
        return mix((above - below) * inverse + (self.ends - self.starts).astype(np.uint64))

    def windows(self, k: int, second: bool = False) -> np.ndarray:
        """The hash of words i to i+k-1 for each i with k words from it on, texts ignored."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        step = min(n, CHUNK_WORDS)
        up, down = (_SECOND_BASE if second else _WORDS_BASE).upto(step + k)
        out = np.empty(n, dtype=np.uint64)
        for a in range(0, n, step):
            h = self.hashes[a : min(a + step, n) + k - 1]
            total = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * up[: len(h)], out=total[1:])
            out[a : a + step] = mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])
        return out


def sized(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK_BYTES, as (first row, end row, bytes, offsets); null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, n)
        yield at, end, data, offsets[at : end + 1]
        at = end


def words(column: pa.Array, lower: bool, separators: np.ndarray = _SEPARATOR) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of the column's texts."""
    for at, end, data, offsets in sized(column):
        yield at, end, Words(data, offsets, lower, separators)
