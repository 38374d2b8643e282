"""Mixing sources to target weights.

Words per source are summed, targets derived from weights, and each document is emitted
floor(rate) times plus once more if a number in [0, 1) drawn from its own hash is below the
rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and no source more than this multiple of its own.
SHARE, MOST = 1.5, 2.0
#: A table of this many sources is broadcast; a longer one is joined by shuffling.
MOST_BROADCAST = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, null last, take the weights in turn. A target is weight * level,
    stopped at ``most`` times the source's size; the level is such that targets add up to ``share``
    of all words. That is where resharing the excess by weight ends: with sources in order of the
    level at which they stop, the first k stop, for the least k whose next source does not.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn("__w", F.element_at(listed, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("__stop", F.col("source_size") * F.lit(float(most)) / F.col("__w"))
    up = Window.orderBy("__stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.sum("source_size").over(all_) * F.lit(float(share))).alias("__total"),
        (F.coalesce(F.sum("source_size").over(up), F.lit(0)) * F.lit(float(most))).alias("__stopped"),
        (F.sum("__w").over(all_) - F.coalesce(F.sum("__w").over(up), F.lit(0.0))).alias("__left"),
    )
    rows = rows.withColumn("__level", (F.col("__total") - F.col("__stopped")) / F.col("__left"))
    rows = rows.withColumn("__k", F.row_number().over(Window.orderBy("__stop", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("__level") <= F.col("__stop"), F.struct("__k", "__level"))).over(all_)["__level"]
    return rows.select(
        "source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.col("__w") * F.coalesce(level, F.lit(float("inf")))).alias("target")
    )


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone (52 bits of an MD5)."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(documents: DataFrame, key: Sequence[str] = ("doc_id", "text"), **how) -> DataFrame:
    """One row per document: its columns, ``size``, ``source_size``, ``target`` and ``copies``.

    Columns with those four names are replaced. A null source is a source of its own, sorted
    last; a null or empty text has size 0; an empty table gives an empty result. Sources without
    words have target 0 and rate 0. The draw depends on the ``key`` columns, so documents that
    agree in them, repeated rows too, agree in their copies; reruns agree.
    """
    rows = documents.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, **how).withColumnRenamed("source", "__source"), "targets")
    targets = F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = (uniform(*[F.col(k) for k in key]) < rate - F.floor(rate)).cast("long")
    return rows.withColumn("copies", F.floor(rate).cast("long") + drawn)


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says, with the columns of ``documents``."""
    chosen = copies(documents, **how).where("copies > 0")
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in documents.columns])
