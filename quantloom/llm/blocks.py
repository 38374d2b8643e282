"""Comparing the members of buckets without gathering a large bucket or emitting pairs.

``dealt`` splits buckets of more than ``block`` rows into blocks, and deals each two blocks of a
bucket as a group of their own; ``whole_groups`` then hands a task its groups, whole, in tables of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: A list of split buckets up to this long is broadcast (12 bytes each); a longer one is joined by shuffling.
MOST_BROADCAST = 1 << 20


def dealt(rows: DataFrame, bucket: str, member: str, block: int, alike: str | None = None) -> DataFrame:
    """``rows`` with ``part``, ``lot`` and ``side``, partitioned and sorted by group (bucket, part, lot).

    A bucket of up to ``block`` rows is one group. A larger one has its members hashed into blocks;
    every row goes to a group with each block of its bucket. ``side`` is -1 where all pairs of a
    group are to be compared, else the row's block, and pairs across sides are.

    ``alike`` names a boolean column: rows that have it true need not meet each other. They get
    blocks of their own, and a group for each block of the others only, so that few rows among very
    many that are alike cost copies of the few.
    """
    same = F.coalesce(F.col(alike), F.lit(False)) if alike else F.lit(False)
    full = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("k")).where(F.col("n") > block)
    listed = [F.ceil(F.col("k") / block).cast("int").alias("first"), F.ceil((F.col("n") - F.col("k")) / block).cast("int").alias("rest")]
    full = written(full.select(bucket, *listed), "full-buckets")
    n = full.count()
    zero, alone = F.lit(0).cast("int"), F.lit(-1).cast("int")
    if not n:
        out = rows.select("*", zero.alias("part"), zero.alias("lot"), alone.alias("side"))
    else:
        split = rows.join(F.broadcast(full) if n <= MOST_BROADCAST else full, bucket, "left")
        hashed = F.xxhash64(member)
        own = F.when(same, F.pmod(hashed, F.col("first"))).otherwise(F.col("first") + F.pmod(hashed, F.col("rest"))).cast("int")
        others = F.sequence(F.when(same, F.col("first")).otherwise(zero), F.col("first") + F.col("rest") - 1)
        split = split.withColumn("own", F.when(F.col("first").isNull(), zero).otherwise(own))
        split = split.withColumn("other", F.explode(F.when(F.col("first").isNull(), F.array(zero)).when(same & (F.col("rest") == 0), F.array().cast("array<int>")).otherwise(others)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(low == high, alone).otherwise(F.col("own"))
        out = split.select(*rows.columns, low.alias("part"), high.alias("lot"), side.alias("side"))
    return out.repartition(bucket, "part", "lot").sortWithinPartitions(bucket, "part", "lot")


def whole_groups(batches: Iterator[pa.RecordBatch], bucket: str, portion: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds of the groups in them) for whole groups, about ``portion`` rows at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def ready(final: bool) -> tuple[pa.Table, np.ndarray] | None:
        nonlocal held, size
        whole = pa.Table.from_batches(held)
        new = np.zeros(whole.num_rows, bool)
        new[:1] = True
        for name in (bucket, "part", "lot"):
            mark = whole.column(name).to_numpy()
            new[1:] |= mark[1:] != mark[:-1]
        cuts = np.append(np.flatnonzero(new), whole.num_rows)
        if not final:  # the last group may go on in the next batch
            cuts = cuts[:-1]
        held, size = whole.slice(cuts[-1]).to_batches(), whole.num_rows - int(cuts[-1])
        return (whole.slice(0, cuts[-1]), cuts) if cuts[-1] else None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= portion and (some := ready(False)):
                yield some
    if size and (some := ready(True)):
        yield some


def roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) over links between places i and j."""
    names, place = np.unique(np.concatenate((ids[i], ids[j])), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return names, names[root]
        root = new
