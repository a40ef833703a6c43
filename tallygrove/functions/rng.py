"""Replayable random numbers: a hash of (seed, stream, number), the same in any engine, partitioning and order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *numbers: Column) -> Column:
    """In (0, 1): the first 32 bits of the key's MD5 and a half, over 2**32."""
    key = F.concat_ws(":", F.lit(f"{seed}:{stream}"), *(n.cast("string") for n in numbers))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, stream: str, *numbers: Column) -> Column:
    """Standard normal, by Box and Muller."""
    a, b = uniform(seed, stream + "/a", *numbers), uniform(seed, stream + "/b", *numbers)
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)


def slot(seed: int, stream: str, n: Column, *numbers: Column) -> Column:
    """A draw from 0 to n - 1."""
    return F.floor(uniform(seed, stream, *numbers) * n).cast("int")


#: MD5's constants and rotations, a round each.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys at a time: their arrays stay in a core's cache.
_LANES = 10_000


def _md5_block(state: list[np.ndarray], words: list[np.ndarray | int]) -> list[np.ndarray]:
    """MD5's state after one block of 16 words, each an array over the keys or a number that all share."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + _SINES[i]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        f >>= np.uint32(32 - _TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


class Uniforms:
    """uniform(seed, stream, i, last) for every i from 0 to n - 1 at once, inside a task: the keys' MD5 in arrays."""

    def __init__(self, seed: int, stream: str, n: int) -> None:
        self.prefix, self.n = f"{seed}:{stream}:".encode(), n
        ends = [0, *(10**d for d in range(1, len(str(n))) if 10**d < n), n]
        #: Rows whose number has the same digits, with the length of prefix and number.
        self.groups = [(low, high, len(self.prefix) + len(str(low))) for low, high in zip(ends, ends[1:], strict=False)]
        self.width = self.groups[-1][2]
        self.heads = np.array([self.prefix + b"%d" % i for i in range(n)], f"S{self.width}").view(np.uint8).reshape(n, self.width)
        self.room, self.keys = 0, []

    def of(self, last: str | None = None) -> np.ndarray:
        """``last`` is the key's second number as a string; without it the key ends with i."""
        tail = np.frombuffer((b"" if last is None else b":" + last.encode()) + b"\x80", np.uint8)
        if len(tail) != self.room:  # all but the tail's own bytes is the same for the next one of its length
            self.room, self.keys = len(tail), [self._blank(low, min(low + _LANES, self.n), len(tail)) for low in range(0, self.n, _LANES)]
        return np.concatenate([self._first(keys, ends, low, tail) for low, (keys, ends) in zip(range(0, self.n, _LANES), self.keys, strict=True)])

    def _groups(self, first: int, end: int) -> Iterator[tuple[slice, int]]:
        for low, high, length in self.groups:
            if low < end and high > first:
                yield slice(max(low, first) - first, min(high, end) - first), length

    def _blank(self, first: int, end: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded keys with room for a tail, and each key's blocks."""
        keys = np.zeros((end - first, 64 * -(-(self.width + room + 8) // 64)), np.uint8)
        keys[:, : self.width] = self.heads[first:end]
        ends = np.empty(end - first, np.int64)
        for rows, length in self._groups(first, end):
            own = -(-(length + room + 8) // 64)
            keys[rows, 64 * own - 8 : 64 * own] = np.frombuffer((8 * (length + room - 1)).to_bytes(8, "little"), np.uint8)
            ends[rows] = own
        return keys, ends

    def _first(self, keys: np.ndarray, ends: np.ndarray, first: int, tail: np.ndarray) -> np.ndarray:
        for rows, length in self._groups(first, first + len(keys)):
            keys[rows, length : length + len(tail)] = tail
        words = keys.view("<u4")
        differ = range(len(self.prefix) // 4, -(-(self.width + len(tail)) // 4))
        column = lambda w: np.ascontiguousarray(words[:, w]) if w in differ or w % 16 == 14 else int(words[0, w])
        state = [np.full(len(keys), x, np.uint32) for x in _START]
        for k in range(words.shape[1] // 16):
            after = _md5_block(state, [column(16 * k + w) for w in range(16)])
            state = after if not k else [np.where(ends > k, x, y) for x, y in zip(after, state, strict=True)]
        return (state[0].byteswap() + 0.5) / 4294967296.0  # the digest's first bytes are the state's, the least first


def normals(seed: int, stream: str, n: int) -> np.ndarray:
    """normal(seed, stream, i) for every i from 0 to n - 1, inside a task."""
    a, b = Uniforms(seed, stream + "/a", n).of(), Uniforms(seed, stream + "/b", n).of()
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * math.pi * b)
