"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to eight random directions per table and decoded to the nearest point
of the lattice E8, which names a home cell; the nearest point of the lattice's other coset, the
neighbouring cell that is easiest to miss, is probed as well. Vectors that meet in a cell, one of
them at home there, are compared by cosine in double precision.

What a cell's task emits is, per vector, how many links it owns and the smallest vector reachable
by links within what the task sees: rows in proportion to vectors, never to pairs. Each link is
counted in one place only: the first table in which its vectors meet, at a cell that both can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import components
from .runtime import tidy, written
from .text import mixed

#: A pair at cosine 0.95 meets in a table with probability 0.23, so 16 tables find 98.5 % of such pairs and more of closer ones.
TABLES, SCALE = 16, 1.0
#: Cells with more members are split into blocks of about this size, and each two blocks compared by themselves.
BLOCK = 1024
_SMALL = 24
_PORTION = 1 << 15


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: round, and if the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(error, worst, -1) >= 0, 1.0, -1.0)
    odd = (near.sum(-1, keepdims=True) % 2) != 0
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + np.where(odd, step, 0.0), -1)
    return near


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest point, nearest point of the other coset) of E8 = D8 and D8 + 1/2, for points along the last axis."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    first = (np.square(x - whole).sum(-1) <= np.square(x - half).sum(-1))[..., None]
    return np.where(first, whole, half), np.where(first, half, whole)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, probed cell) of each vector in each table, as 64-bit names."""
    n, width = unit.shape
    directions = np.random.Generator(np.random.PCG64([8, width])).standard_normal((width, TABLES * 8)) * SCALE
    points = decode_e8((unit @ directions).reshape(n, TABLES, 8))
    out = []
    with np.errstate(over="ignore"):
        for point in points:
            name = np.broadcast_to(mixed(np.arange(TABLES, dtype=np.uint64) + np.uint64(width << 16)), (n, TABLES))
            for k in range(8):
                name = mixed(name ^ (point[..., k] * 2).astype(np.int64).view(np.uint64))
            out.append(name.view(np.int64))
    return out[0], out[1]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all vectors in a row, their bounds)."""
    return np.asarray(column.flatten(), np.float64), np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each vector length in the column."""
    flat, bounds = _vectors(column)
    widths = np.diff(bounds)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x = flat[bounds[at][:, None] + np.arange(width)]
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(group: np.ndarray, side: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of rows of one group (sorted) with cosine ``least`` or more; of a group with two sides, across sides."""
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(cuts)
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        one.append(i)
        other.append(j)

    ends = np.repeat(cuts[1:], sizes)
    small = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
    for d in range(1, _SMALL):
        i = small[small + d < ends[small]]
        if not len(i):
            break
        near = np.einsum("ij,ij->i", unit[i], unit[i + d]) >= least
        keep(i[near], i[near] + d)
    for a, b in zip(cuts[:-1][sizes > _SMALL], cuts[1:][sizes > _SMALL], strict=True):
        for s in range(a, b, BLOCK):
            i, j = np.nonzero(unit[s : min(s + BLOCK, b)] @ unit[s:b].T >= least)
            keep(i[i < j] + s, j[i < j] + s)
    i, j = np.concatenate(one), np.concatenate(other)
    apart = side[i] != side[j]
    whole = (side[i] < 0) | (side[j] < 0)
    return i[apart | whole], j[apart | whole]


def _links(batch: pa.Table, cuts: np.ndarray, least: float) -> pa.RecordBatch | None:
    """Owned link counts and local roots for whole groups of rows (cell, home, id, copies, vector, side)."""
    cell, number = batch.column("cell").to_numpy(), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    side, home, ids, copies = (batch.column(k).to_numpy() for k in ("side", "home", "id", "copies"))
    vectors = batch.column("vector").combine_chunks()
    out_i, out_j, own = [], [], []
    for at, unit in _by_width(vectors):
        i, j = _pairs(number[at], side[at], unit, least)
        meet = (home[at][i] | home[at][j]) & (ids[at][i] != ids[at][j])
        i, j = i[meet], j[meet]
        if not len(i):
            continue
        used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        homes, probes = cells(unit[used])
        owns = np.zeros(len(i), bool)
        for s in range(0, len(i), _PORTION):
            a, b = place[: len(i)][s : s + _PORTION], place[len(i) :][s : s + _PORTION]
            x, y = i[s : s + _PORTION], j[s : s + _PORTION]
            swap = ids[at][x] > ids[at][y]
            a, b = np.where(swap, b, a), np.where(swap, a, b)  # a: of the smaller id
            same, at_a, at_b = homes[a] == homes[b], homes[a] == probes[b], probes[a] == homes[b]
            table = (same | at_a | at_b).argmax(1)
            row = np.arange(len(a))
            where = np.where(same[row, table] | at_a[row, table], homes[a, table], homes[b, table])
            owns[s : s + _PORTION] = where == cell[at][x]
        out_i.append(at[i])
        out_j.append(at[j])
        own.append(owns)
    if not out_i:
        return None
    i, j, own = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(own)
    names, root = blocks.roots(ids, i, j)
    count = np.zeros(len(names), np.int64)
    np.add.at(count, np.searchsorted(names, ids[i[own]]), copies[j[own]])
    np.add.at(count, np.searchsorted(names, ids[j[own]]), copies[i[own]])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(count), pa.array(root)], names=["id", "links", "root"])


def near_vectors(vectors: DataFrame, similarity: float = 0.95, portion: int = 1 << 15) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Pairs found with cosine ``similarity`` or more, in double precision, are linked, and no others;
    vectors of different lengths are not compared. ``n_links`` counts the other rows linked
    directly, copies too; ``component_id`` is the smallest vec_id reachable, itself included.

    A null or zero vector, or one with a null or non-finite component, links with nothing and is
    its own component. A row without vec_id links with nothing, has no component_id and is kept.
    Identical vectors form a class that is hashed once; repeated rows are members of it. An empty
    table gives an empty result. Columns other than vec_id and embedding are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce(finite & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    classes = rows.where(able).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "vector-classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _by_width(batch.column(0)):
                homes, probes = cells(unit)
                both = np.concatenate((homes, probes), axis=1)
                take = np.repeat(at, 2 * TABLES)
                home = np.tile(np.arange(2 * TABLES) < TABLES, len(at))
                for s in range(0, len(take), 1 << 14):
                    some = pa.array(take[s : s + (1 << 14)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both.ravel()[s : s + (1 << 14)]), pa.array(home[s : s + (1 << 14)]), *(batch.column(k).take(some) for k in (1, 2, 0))],
                        names=["cell", "home", "id", "copies", "vector"],
                    )

    placed = classes.select("vector", "id", "copies").mapInArrow(tidy(hashed), f"cell long, home boolean, id long, copies long, vector {kind}")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in blocks.whole_groups(batches, "cell", portion):
            found = _links(rows, cuts, similarity)
            if found is not None:
                yield found

    sorted_ = blocks.dealt(placed, "cell", "id", BLOCK)
    found = written(sorted_.mapInArrow(tidy(compare), "id long, links long, root long"), "vector-links")
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("root").alias("u"), F.col("id").alias("v")))
    known = classes.join(degrees, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    known = known.select(F.col("vector").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("__n"), F.coalesce("component", "id").alias("__c"))
    joined = rows.withColumn("__able", able).join(known, F.col("__able") & (F.col("vector") == F.col("__v")), "left")
    component = F.coalesce("__c", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
