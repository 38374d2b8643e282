"""Connected components by alternating large-star and small-star.

Each step replaces edges by edges to the smallest known neighbour, keeping what is connected
connected, until every component is a star around its smallest node. A node's smallest
neighbour comes from a partial aggregate, never from a gathered neighbour list, and rows are
joined back by key, so that a node with very many edges can be dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, written


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("w"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(sym).select("u", F.least("u", "w").alias("w"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.unionByName(least.select("u", F.col("w").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); component is its smallest reachable node.

    Nulls and loops in ``edges`` are left out; without edges the result is empty.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(edges)) != before:
        step = written(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges, before = step, state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
