"""Uniform numbers of many keys at once: expr.hash_uniform of texts that differ in their last part only, or in several, as arrays of words.

MD5 is run on all keys of a length side by side, and as far as a comparison needs its first word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = ([i for i in range(16)], [(5 * i + 1) % 16 for i in range(16)], [(3 * i + 5) % 16 for i in range(16)], [7 * i % 16 for i in range(16)])
#: Steps after which the first word of the digest stays as it is.
_STEPS = 61
#: Bytes of a text that fits one block.
ONE_BLOCK = 55
#: Keys side by side.
SIDE_BY_SIDE = 1 << 15


def uniform(text: str) -> float:
    """hash_uniform of parts that are joined already."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


class Endings:
    """Numbers in order whose texts are equally long, as words for each of the four places in a word that they may start at."""

    def __init__(self, numbers: np.ndarray, length: int):
        self.numbers, self.length = numbers, length
        text = numbers.astype(f"S{length}").view(np.uint8).reshape(len(numbers), length)
        self.words = []
        for skip in range(4):
            size = -(-(skip + length + 1) // 4)
            padded = np.zeros((len(numbers), size * 4), dtype=np.uint8)
            padded[:, skip : skip + length] = text
            padded[:, skip + length] = 0x80
            self.words.append(np.ascontiguousarray(padded.view("<u4").T.astype(np.uint32)))

    def first_words(self, prefix: bytes, low: int) -> np.ndarray:
        """The first 32 bits of the hashes of prefix + number, for numbers from place low on."""
        start, skip = divmod(len(prefix), 4)
        size = len(prefix) + self.length
        own = self.words[skip][:, low:]
        fixed = np.zeros(64, dtype=np.uint8)
        fixed[: len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)
        fixed[56:] = np.frombuffer((size * 8).to_bytes(8, "little"), dtype=np.uint8)
        message: list = [int(x) for x in fixed.view("<u4")]
        for k, w in enumerate(own):
            message[start + k] = w | np.uint32(message[start + k]) if message[start + k] else w
        return _rounds(message, own.shape[1])[0]


def _rounds(message: list, n: int, steps: int = _STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The first word of the digests, and after all 64 steps the second.

    Words of a message are numbers, or arrays where they differ between keys; states are numbers until the first array.
    """
    a, b, c, d = _START
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    step = 0
    while isinstance(message[step], int):  # in the first round words come in order
        x = (a + (d ^ (b & (c ^ d))) + _SINES[step] + message[step]) & 0xFFFFFFFF
        s = _SHIFTS[0][step % 4]
        a, b, c, d = d, (b + ((x << s | x >> (32 - s)) & 0xFFFFFFFF)) & 0xFFFFFFFF, b, c
        step += 1
    a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in (a, b, c, d))
    for i in range(step, steps):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word, s = message[_PLACES[part][i % 16]], _SHIFTS[part][i % 4]
        np.add(a, f, out=a)
        if isinstance(word, int):
            np.add(a, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, np.uint32(_SINES[i]), out=a)
            np.add(a, word, out=a)
        np.left_shift(a, np.uint32(s), out=t)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    # after _STEPS b is the digest's first word but for the start, and moves on to a
    return ((b if steps == _STEPS else a) + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()


def endings(numbers: np.ndarray) -> list[Endings]:
    """Numbers by the length of their texts, each in order."""
    numbers = np.sort(numbers)
    lengths = np.char.str_len(numbers.astype("S20"))
    return [Endings(numbers[lengths == k], int(k)) for k in np.unique(lengths)]


def below(prefix: str, ends: Endings, low: int, p: np.ndarray) -> np.ndarray:
    """Whether the uniform number of prefix + each number from place low on is below its chance p."""
    if len(prefix) + ends.length > ONE_BLOCK:
        return np.array([uniform(f"{prefix}{x}") for x in ends.numbers[low:]]) < p
    first = ends.first_words(prefix.encode(), low) / 2.0**32
    out = first + 2.0**-32 <= p
    for k in np.flatnonzero(~out & (first < p)):  # the first word doesn't tell
        out[k] = uniform(f"{prefix}{ends.numbers[low + k]}") < p[k]
    return out


#: A part of keys: bytes that all share, or the texts of some bytes that each has, as columns of 64-bit words.
Part = bytes | tuple[Sequence[np.ndarray], int]


def text_words(texts: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words that hold texts (of a dtype S), bytes of zero after them."""
    size = max(1, -(-texts.dtype.itemsize // 8))
    return texts.astype(f"S{8 * size}").view("<u8").reshape(len(texts), size)


def _lanes(parts: list[Part]) -> list:
    """The first seven 64-bit words of the one block that parts in a row fill: numbers, or arrays where keys differ."""
    lanes: list = [0] * 8
    at = 0

    def put(value: int | np.ndarray, size: int) -> None:
        lane, skip = divmod(at, 8)
        if isinstance(value, int):
            lanes[lane] |= value << 8 * skip & 0xFFFFFFFFFFFFFFFF
        else:
            lanes[lane] = (value << np.uint64(8 * skip) if skip else value) | np.uint64(lanes[lane])
        if skip + size > 8:
            lanes[lane + 1] = value >> 8 * (8 - skip) if isinstance(value, int) else value >> np.uint64(8 * (8 - skip))

    for part in [*parts, b"\x80"]:
        columns, size = (None, len(part)) if isinstance(part, bytes) else part
        for k in range(0, size, 8):
            put(int.from_bytes(part[k : k + 8], "little") if columns is None else columns[k // 8], min(8, size - k))
            at += min(8, size - k)
    return lanes[:7]


def size_of(parts: list[Part]) -> int:
    return sum(len(p) if isinstance(p, bytes) else p[1] for p in parts)


def key(parts: list[Part], at: int) -> str:
    """The text of a key."""
    return b"".join(p if isinstance(p, bytes) else b"".join(int(c[at]).to_bytes(8, "little") for c in p[0])[: p[1]] for p in parts).decode()


class Keys:
    """n keys whose texts are put together from parts, for all that have parts of the same sizes at once, and hashed side by side."""

    def __init__(self, n: int):
        self.n, self.lanes, self.sizes = n, [], None
        self.texts: list[tuple[list[Part], np.ndarray]] = []

    def add(self, parts: list[Part], own: np.ndarray | None = None) -> None:
        """The keys of these places, or all, have these parts."""
        size = size_of(parts)
        if size > ONE_BLOCK:
            self.texts.append((parts, np.arange(self.n) if own is None else own))
            return
        lanes = _lanes(parts)
        if own is None:
            self.lanes, self.sizes = lanes, size * 8
            return
        if self.sizes is None:
            self.sizes = np.zeros(self.n, dtype=np.uint32)
        self.sizes[own] = size * 8
        for k in range(size // 8 + 1):
            if k == len(self.lanes):
                self.lanes.append(np.zeros(self.n, dtype=np.uint64))
            self.lanes[k][own] = lanes[k]

    def _message(self, own: slice) -> list:
        out: list = []
        for lane in self.lanes:
            if isinstance(lane, int):
                out += [lane & 0xFFFFFFFF, lane >> 32]
            else:
                both = lane[own].view("<u4").reshape(-1, 2)
                out += [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
        return [*out, *[0] * (14 - len(out)), self.sizes if isinstance(self.sizes, int) else self.sizes[own], 0]

    def _hashed(self, steps: int) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray]]]:
        for k in range(0, self.n if self.lanes else 0, SIDE_BY_SIDE):
            own = slice(k, min(self.n, k + SIDE_BY_SIDE))
            yield own, _rounds(self._message(own), own.stop - own.start, steps)

    def first_words(self) -> np.ndarray:
        """The first 32 bits of the hashes, divided by 2**32."""
        out = np.empty(self.n)
        for own, (first, _) in self._hashed(_STEPS):
            np.multiply(first, 2.0**-32, out=out[own])
        for parts, own in self.texts:
            out[own] = [int(uniform(key(parts, k)) * 2**32) / 2**32 for k in range(len(own))]
        return out

    def uniforms(self) -> np.ndarray:
        """uniform() of the keys."""
        out = np.empty(self.n)
        for own, (first, second) in self._hashed(64):
            np.multiply(first, 2.0**-32, out=out[own])
            out[own] += (second >> np.uint32(12)) * 2.0**-52
        for parts, own in self.texts:
            out[own] = [uniform(key(parts, k)) for k in range(len(own))]
        return out
