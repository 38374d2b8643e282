"""Words of many texts at once, in numpy.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
All of these are ASCII, so working on UTF-8 bytes gives the same words as working on code
points. A word's identity is a 64-bit hash: a polynomial over random byte values, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 2**64)
#: Texts are worked on in runs of about this many bytes, so that scratch arrays stay in cache.
RUN_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[key] = np.multiply.accumulate(steps)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): close inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) for runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    data, bounds = utf8(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and in all, last byte of each word)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.uint8)
    solid = ~_SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    begin, last = np.flatnonzero(starts), np.flatnonzero(ends)
    lower = _LOWER[data]
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[lower] * _power(_BASE, n)[:n], out=total[1:])
        hashed = (total[last + 1] - total[begin]) * _power(_BASE_INV, n)[begin]
        hashed = mixed(hashed ^ (last - begin + 1).astype(np.uint64))
    return hashed, np.searchsorted(begin, bounds), lower[last]


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` words in a row; of fewer words, the whole sequence as one; sorted."""
    n = len(hashed)
    if not n:
        return hashed
    width = min(n, size)
    with np.errstate(over="ignore"):
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total = (total + hashed[k : n - width + 1 + k]) * _U(0xF1357AEA2E62A9C5)
        total = np.sort(mixed(total ^ _U(width * 0x5851F42D4C957F2D % 2**64)))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
