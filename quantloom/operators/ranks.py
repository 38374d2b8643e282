"""Running sums, ranks and order statistics over hot groups or whole tables, in parts that no single task holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256


def _cuts(rows: DataFrame, by: str, parts: int) -> list:
    """Approximate quantiles of the non-null values; which they are decides how work is dealt, never a result."""
    shares = [k / parts for k in range(1, parts)]
    return rows.select(F.percentile_approx(by, shares, 100 * parts)).first()[0] or []


def _place(value: Column, cuts: Sequence) -> Column:
    """How many of the cuts lie below a value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut < value))


def _parted(rows: DataFrame, by: str, key: str | None, parts: int) -> DataFrame:
    """``__part`` rises with (by, key), nulls first. A value that many rows share has parts of its own, dealt by a numeric ``key``."""
    cuts = _cuts(rows, by, parts)
    frequent = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    value = F.col(by)
    alone = value.isin(frequent) if frequent else F.lit(False)
    coarse = F.when(value.isNull(), -1).otherwise(2 * _place(value, sorted(set(cuts))) + alone.cast("int"))
    fine = F.lit(0)
    if key is not None:
        within = sorted(set(_cuts(rows, key, parts)))
        fine = F.when(value.isNull() | alone, F.when(F.col(key).isNull(), -1).otherwise(_place(F.col(key), within))).otherwise(0)
    return rows.withColumn("__part", coarse.cast("long") * (parts + 2) + fine)


def running_sum(rows: DataFrame, group: Sequence[str], by: str, weight: Column, key: str | None = None, parts: int = PARTS, name: str = "running", total: str = "total") -> DataFrame:
    """Each row's sum of ``weight`` up to and with itself in the order of (by, key), and its group's ``total``.

    Parts are summed first and every row adds what came before its part, so that a window holds one part of a
    group. Nulls of ``by`` come first; null groups are groups. Rows equal in (by, key) come in any order.
    """
    parted = _parted(rows, by, key, parts).withColumn("__w", weight)
    order = [by] if key is None else [by, key]
    sums = parted.groupBy(*group, "__part").agg(F.sum("__w").alias("__s"))
    along = Window.partitionBy(*group).orderBy("__part")  # at most a few rows a part
    before = F.coalesce(F.sum("__s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__part").alias("__p"), before.alias("__before"), F.sum("__s").over(Window.partitionBy(*group)).alias(total))
    met = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    inner = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = parted.withColumn("__inner", F.sum("__w").over(inner)).join(sums, met)
    return run.withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__p", "__w", "__inner", "__before", *[f"__g{k}" for k in range(len(group))])


def ranked(rows: DataFrame, by: str, key: str, group: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """``rank`` from 1 in the order of (by, key), and ``n``, the number of rows of the group."""
    return running_sum(rows, group, by, F.lit(1).cast("long"), key, parts, "rank", "n")


def equal_parts(rank: Column, n: Column, parts: int) -> Column:
    """The number, from 1, of the equal-sized part that a rank falls into; earlier parts take what is left over."""
    size, longer = F.floor(n / parts), n % parts
    head = longer * (size + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (size + 1))).otherwise(longer + F.floor((rank - 1 - head) / F.greatest(size, F.lit(1)))) + 1


def _cells(rows: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    return running_sum(counted, group, value, F.col("__n"), None, parts, "__upto", "__all")


def nearest_ranks(rows: DataFrame, group: Sequence[str], value: str, shares: Mapping[str, float], parts: int = PARTS) -> DataFrame:
    """Per group, under each name, the ceil(p * n)-th smallest value (the smallest for 0). Nulls are left out."""
    c = _cells(rows, group, value, parts)
    picked = [F.min(F.when(F.col("__upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("__all"))), F.col(value))).alias(name) for name, p in shares.items()]
    return c.groupBy(*group).agg(*picked)


def trimmed_means(rows: DataFrame, group: Sequence[str], value: str, trim: float, name: str = "mean", parts: int = PARTS) -> DataFrame:
    """Per group the mean without floor(trim * n) values at each end. Nulls are left out."""
    c = _cells(rows, group, value, parts)
    low = F.floor(F.lit(trim) * F.col("__all"))
    kept = F.greatest(F.lit(0), F.least(F.col("__upto"), F.col("__all") - low) - F.greatest(F.col("__upto") - F.col("__n"), low))
    return c.withColumn("__kept", kept).groupBy(*group).agg((F.sum(F.col(value) * F.col("__kept")) / F.sum("__kept")).alias(name))
