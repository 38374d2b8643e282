"""Sharding: a Feistel permutation over global row numbers.

Rows get global numbers, a keyed permutation of 0..n-1 moves each number to a position, and
position p is slot ``p // shards`` of shard ``p % shards``. Shard sizes differ by one row at
most. Anyone who knows the seed, n and the number of shards can compute where row i went, and,
as the permutation can be inverted, which row sits in a given slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

#: Row numbers are dealt in this many buckets of a content hash; their counts are the only table that is broadcast.
BUCKETS = 4096
#: Rows that occur more often than this are numbered in pieces of as many.
PIECE = 4096
#: A list of rows that occur more often than that is broadcast up to this length (16 bytes each); a longer one is joined by shuffling.
MOST_BROADCAST = 1 << 20
ROUNDS = 6


def _round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"feistel|{seed}|{k}".encode()).digest()[:8], "big") for k in range(ROUNDS)]


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The position in 0..n-1 of each number in 0..n-1, or with ``back`` the number at each position.

    A balanced Feistel network permutes 0..4**w-1, the smallest such domain that holds n; a value
    that leaves 0..n-1 is sent through again until it is back (cycle walking), which keeps the map
    one to one on 0..n-1. The domain is under 4n, so that takes under four rounds on average.
    """
    width = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << width) - 1), np.uint64(width)
    keys = _round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, key) & low), left
            else:
                left, right = right, left ^ (_mix(right, key) & low)
        return (left << shift) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while len(away := np.flatnonzero(out >= np.uint64(n))):
        out[away] = once(out[away])
    return out.astype(np.int64)


def _identity(columns: list[Column]) -> list[Column]:
    """Two 64-bit hashes of a row; which columns are null is hashed too, as hashes pass over nulls."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *columns).alias(name) for seed, name in ((1, "__h"), (2, "__i"))]


def numbered(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """``rows`` with a global number from 0 without gaps; a column called ``name`` is replaced.

    The numbers depend on the rows' contents alone, not on how they are partitioned. Rows are counted
    by two 64-bit hashes of all their columns; hashes are dealt into buckets, sorted within a bucket
    and numbered, so all that is sorted are hashes and counts. Each row then finds its number by its
    hashes, which moves whole rows once. Identical rows have neighbouring numbers. Of rows that
    occur more than ``PIECE`` times one stands for all, counted before it is moved, and its numbers
    are dealt out in pieces, so a row that is repeated very often is no burden to one task.
    """
    rows = rows.drop(name)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hashed = rows.select(*columns, *_identity(columns))
    runs = hashed.groupBy("__h", "__i").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("__b").agg(F.sum("__n").alias("__m"))
    starts = sizes.select("__b", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__s"), F.sum("__m").over(Window.partitionBy()).alias("__total"))
    within = Window.partitionBy("__b").orderBy("__h", "__i").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__first", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(starts), "__b")
    runs = written(runs.select("__h", "__i", "__n", (F.col("__first") + F.col("__s")).alias("__first"), "__total"), "row-numbers")

    found = hashed.join(runs.where(F.col("__n") <= PIECE).hint("merge"), ["__h", "__i"])
    copy = F.row_number().over(Window.partitionBy("__h", "__i").orderBy(*[c.asc_nulls_first() for c in columns])) - 1
    short = found.select(*columns, (F.col("__first") + copy).alias(name), "__total")
    frequent = runs.where(F.col("__n") > PIECE)
    listed = frequent.count()
    if not listed:
        return short
    often = hashed.join(F.broadcast(frequent.select("__h", "__i")) if listed <= MOST_BROADCAST else frequent.select("__h", "__i"), ["__h", "__i"], "left_semi")
    often = often.groupBy("__h", "__i").agg(F.min(F.struct(*columns)).alias("__row")).join(frequent, ["__h", "__i"])
    pieces = often.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("__n") - 1) / PIECE).cast("long"))))
    last = F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE) - 1
    spread = pieces.repartition("__first", "__piece").withColumn("__k", F.explode(F.sequence(F.col("__piece") * PIECE, last)))
    return short.unionByName(spread.select("__row.*", (F.col("__first") + F.col("__k")).alias(name), "__total"))


def shard_rows(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 in each shard).

    Columns with those three names are replaced; all others, whatever their names, are carried.
    Null values, empty and long texts are values like any other; repeated rows each get a slot of
    their own; an empty table gives an empty result. Shard sizes differ by one row at most.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    clear = rows.drop("row_number", "shard", "slot", "__total")

    @F.pandas_udf("long")
    def position(number: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]) if len(total) else 1, seed), dtype="int64")

    placed = numbered(clear).withColumn("__p", position("row_number", "__total"))
    return placed.select(
        *[F.col(f"`{c}`") for c in clear.columns],
        "row_number",
        F.pmod("__p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__p") / shards).cast("long").alias("slot"),
    )
