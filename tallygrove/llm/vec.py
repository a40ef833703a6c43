"""Vectorised hashing of words and characters: the inner loops of the deduplication operators.

Hashes are 64-bit polynomials over random values of bytes or code points, read off prefix sums modulo 2**64 and mixed, so a
batch costs a few passes over its characters. Batches are cut at about ``CHUNK`` characters, and a longer text is one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_500_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _random.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
#: Odd multipliers, for sequences of hashes and for the permutations of MinHash.
ODD = _random.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
ODD32 = _random.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base, and those of its inverse, at least ``n`` of each."""
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE, U64)]))
        _inverses = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _INVERSE, U64)]))
    return _powers, _inverses


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums, from 0, of values times the powers of the base."""
    base, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * base[: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of each span; it does not depend on where the span lies."""
    _, inverses = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * inverses[start] + (stop - start).astype(U64))


def slices(lengths: list[int] | np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut where ``column`` holds more than about ``most`` bytes, so that a worker unpacks little at a time."""
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), most):
            yield batch.slice(a, b - a)


def words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (and the last one's end). fold: A-Z count as a-z."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    change = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, stop = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    hashes = spans(sums((_FOLDED if fold else _BYTES)[raw]), start, stop)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return hashes, np.searchsorted(start, begins)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` hashes in a row; whether they belong together is the caller's matter."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out += hashes[j : j + n] * ODD[j]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct elements in order; for short arrays a fraction of the cost of numpy's own."""
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate([[True], new])]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct elements share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def minima(x32: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (rows) of each group (columns) of 32-bit hashes. Each group has a member."""
    out, turned = np.empty((n, len(begins)), np.uint32), np.empty_like(x32)
    for j in range(n):
        np.minimum.reduceat(np.multiply(x32, ODD32[j], out=turned), begins, out=out[j])
    return out


def band_keys(values: np.ndarray, bands: list[list[int]]) -> np.ndarray:
    """values: signature places by items. A key for each band (its places in the signature) and item."""
    out = []
    for number, places in enumerate(bands):
        key = np.full(values.shape[1], number + 1, U64) * ODD[40]
        for j, place in enumerate(places):
            key += values[place].astype(U64) * ODD[j]
        out.append(mix(key))
    return np.array(out).reshape(-1, values.shape[1])


def draws_of(n: int, rows: int, places: int) -> list[list[int]]:
    """``n`` bands of ``rows`` places each, drawn anew from the same ``places`` for every band."""
    rng = np.random.Generator(np.random.PCG64(11))
    return [sorted(rng.choice(places, rows, replace=False).tolist()) for _ in range(n)]


def own_of(n: int, rows: int) -> list[list[int]]:
    """``n`` bands of ``rows`` places each, all places distinct: bands agree or differ independently."""
    return [list(range(i * rows, (i + 1) * rows)) for i in range(n)]
