"""Packets: arrays of whole numbers in one binary value, and rows that carry them between tasks.

A packet is far smaller than a row per number, so a shuffle of packets moves few bytes and the JVM
touches few rows. Rows are (to, kind, source, payload): ``to`` names the block or slice that they go to.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "to long, kind int, source long, payload binary"
#: Most partitions of one shuffle; beyond it, a task takes several blocks or slices in turn.
MOST_PARTITIONS = 20_000
_BATCH_BYTES = 4 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, each in the fewest bytes that hold its largest number, byte place by byte place, compressed."""
    head, parts = [len(arrays)], []
    for a in arrays:
        a = np.asarray(a)
        a = a.view(np.uint64) if a.dtype == np.int64 else a.astype(np.uint64)
        most = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        head += [width, len(a)]
        parts.append(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` took, as unsigned 64-bit numbers viewed as signed."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 2 * n)[1:].reshape(n, 2).tolist()
    out, at = [], 8 * (1 + 2 * n)
    for width, size in head:
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64).view(np.int64))
        at += width * size
    return out


def steps(increasing: np.ndarray) -> np.ndarray:
    """Differences of increasing numbers, the first from 0; ``np.cumsum`` undoes it."""
    out = increasing.copy()
    out[1:] -= increasing[:-1]
    return out


def ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct number in ascending order, rank of each one's number among them).

    The numbers, not negative, are sorted with their places in the lowest bits, which is faster than sorting
    places. Numbers that leave no room there lose their own lowest bits in it; if that put two that
    differ out of order, places are sorted instead.
    """
    n = len(numbers)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = numbers.view(np.uint64)
    room = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    both = np.sort(((keys << np.uint64(64 - max(1, int(keys.max()).bit_length()))) & ~room) | np.arange(n, dtype=np.uint64))
    order = (both & room).astype(np.int64)
    own = keys[order]
    if (own[1:] < own[:-1]).any():
        order = np.argsort(keys, kind="stable")
        own = keys[order]
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def batches_of(rows: Iterable[tuple[int, int, int, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Record batches of ``SCHEMA`` of a few megabytes each."""
    held, size = [], 0

    def ready() -> pa.RecordBatch:
        to, kind, source, payload = zip(*held, strict=True)
        columns = [pa.array(to, pa.int64()), pa.array(kind, pa.int32()), pa.array(source, pa.int64()), pa.array(payload, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["to", "kind", "source", "payload"])

    for row in rows:
        held.append(row)
        size += 32 + len(row[3] or b"")
        if size > _BATCH_BYTES:
            yield ready()
            held, size = [], 0
    if held:
        yield ready()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        to, kind, source = (batch.column(k).to_pylist() for k in range(3))
        for k in range(batch.num_rows):
            yield to[k], kind[k], source[k], batch.column(3)[k].as_py()


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(to, [(kind, source, payload)]) for rows that ``gathered`` has put next to each other."""
    name, held = None, []
    for to, *rest in rows_of(batches):
        if held and to != name:
            yield name, held
            held = []
        name = to
        held.append(tuple(rest))
    if held:
        yield name, held


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """Rows of one ``to`` (numbers from 0, about ``n`` of them) in one partition, next to each other, by kind and source."""
    n = max(1, min(n, MOST_PARTITIONS))
    return rows.repartitionById(n, F.pmod("to", F.lit(n)).cast("int")).sortWithinPartitions("to", "kind", "source")
