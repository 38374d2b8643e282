"""Market movement across symbols: breadth, robust cross-sections, weights, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the classification.
BROAD_SHARE, MATERIAL_SHARE, MATERIAL_Z, MEDIAN_Z, PACE_SHARE = 0.70, 0.50, 1.0, 0.50, 0.60
MAD_SCALE, WEIGHT_CAP, TRIM = 0.6745, 0.25, 0.10
LEAST_SYMBOLS, LEAST_SHARE = 5, 0.60


def breadth(rows: DataFrame, boundary: str, ret: str = "ret") -> DataFrame:
    """Per boundary the numbers of rising and falling symbols and the median return."""
    r = F.col(ret)
    out = rows.groupBy(boundary).agg(F.count(r).alias("n"), F.count_if(r > 0).alias("rising"), F.count_if(r < 0).alias("falling"), F.median(r).alias("median_return"))
    return out.select(boundary, "n", "rising", "falling", F.round(F.col("rising") / F.col("n"), 6).alias("rising_share"), "median_return")


def cross_z(rows: DataFrame, boundary: str, ret: str) -> DataFrame:
    """``z``: 0.6745 * (x - median) / MAD across the symbols of a boundary."""
    w = Window.partitionBy(boundary)
    mid = rows.withColumn("__mid", F.median(ret).over(w))
    mad = mid.withColumn("__mad", F.median(F.abs(F.col(ret) - F.col("__mid"))).over(w))
    return mad.withColumn("z", F.when(F.col("__mad") > 0, MAD_SCALE * (F.col(ret) - F.col("__mid")) / F.col("__mad"))).drop("__mid", "__mad")


def capped_weights(notional: Column, cap: float = WEIGHT_CAP, rounds: int = 16) -> Column:
    """Of an array of notionals: weights by square root, none above ``cap``, the excess shared by the others; null if cap * n < 1."""
    raw = F.transform(notional, lambda v: F.sqrt(v))

    def step(state: Column, _: Column) -> Column:
        w, fixed = state["w"], state["fixed"]
        fixed = F.zip_with(w, fixed, lambda x, f: f | (x > cap + 1e-12))
        held = F.aggregate(fixed, F.lit(0.0), lambda a, f: a + F.when(f, cap).otherwise(0.0))
        free = F.aggregate(F.zip_with(raw, fixed, lambda x, f: F.when(f, 0.0).otherwise(x)), F.lit(0.0), lambda a, v: a + v)
        new = F.zip_with(raw, fixed, lambda x, f: F.when(f, F.lit(cap)).otherwise(x * (1 - held) / free))
        return F.struct(new.alias("w"), fixed.alias("fixed"))

    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    start = F.struct(F.transform(raw, lambda v: v / total).alias("w"), F.transform(raw, lambda v: F.lit(False)).alias("fixed"))
    return F.when(F.size(notional) * cap >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["w"])


def classify(rows: DataFrame, boundary: str, universe: int) -> DataFrame:
    """Per boundary BROAD_RISE, BROAD_DROP, NEUTRAL or WARMING, from symbols' ``ret``, ``z`` and ``acceleration``."""
    r, z, a = F.col("ret"), F.col("z"), F.col("acceleration")
    g = rows.where(r.isNotNull() & z.isNotNull()).groupBy(boundary).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r > 0).alias("up"), F.count_if(r < 0).alias("down"), F.count_if((r > 0) & (F.abs(z) >= MATERIAL_Z)).alias("up_material"),
        F.count_if((r < 0) & (F.abs(z) >= MATERIAL_Z)).alias("down_material"), F.median(r).alias("mid"), F.median(z).alias("mid_z"), F.count_if(a > 0).alias("faster"), F.count_if(a < 0).alias("slower"),
    )
    n = F.col("n")
    ready = (n >= LEAST_SYMBOLS) & (n >= LEAST_SHARE * universe)
    rise = (F.col("up") >= BROAD_SHARE * n) & (F.col("up_material") >= MATERIAL_SHARE * n) & (F.col("mid") > 0) & (F.col("mid_z") >= MEDIAN_Z)
    drop = (F.col("down") >= BROAD_SHARE * n) & (F.col("down_material") >= MATERIAL_SHARE * n) & (F.col("mid") < 0) & (F.col("mid_z") <= -MEDIAN_Z)
    label = F.when(~ready, "WARMING").when(rise, "BROAD_RISE").when(drop, "BROAD_DROP").otherwise("NEUTRAL")
    pace = F.when(F.col("faster") >= PACE_SHARE * n, "accelerating").when(F.col("slower") >= PACE_SHARE * n, "decelerating").otherwise("steady")
    return g.select(boundary, "n", label.alias("state"), pace.alias("pace"))
