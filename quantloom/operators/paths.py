"""Paths after an event: first passage, barriers, breaks, excursions; and level events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling


def ahead(column: str, steps: int) -> Column:
    """The next ``steps`` values as an array, null unless there are so many."""
    held = F.collect_list(column).over(rolling.by_symbol().rowsBetween(1, steps))
    return F.when(F.size(held) == steps, held)


def first_where(path: Column, test) -> Column:
    """The 1-based place of the first value that passes, else null."""
    at = F.array_position(F.transform(path, test), F.lit(True))
    return F.when(at > 0, at)


def barrier_outcome(up: Column, down: Column) -> Column:
    """1 if up comes first, -1 if down does, 0 if both at once, null if neither."""
    far = F.lit(2**31 - 1)
    u, d = F.coalesce(up, far), F.coalesce(down, far)
    return F.when((u == far) & (d == far), None).when(u < d, 1).when(d < u, -1).otherwise(0)


def excursion_grid(rows: DataFrame, high: Column, low: Column, base: Column, widths: Sequence[float]) -> DataFrame:
    """Per stop and target width: share of paths that reach the target before the stop (both at once counts as the stop)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("stop"), F.lit(float(t)).alias("target")) for s in widths for t in widths])).alias("g")
    spread = rows.select(high.alias("h"), low.alias("l"), base.alias("b"), grid)
    t = first_where(F.col("h"), lambda v: v >= F.col("b") * (1 + F.col("g.target")))
    s = first_where(F.col("l"), lambda v: v <= F.col("b") * (1 - F.col("g.stop")))
    out = spread.select("g.stop", "g.target", barrier_outcome(t, s).alias("o"))
    return out.groupBy("stop", "target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o") == 1).alias("reached"), F.count_if(F.col("o") <= 0).alias("stopped"))


def cross_section_extremes(rows: DataFrame, time: str, value: str, least_spread: float) -> DataFrame:
    """Per time the one symbol at the top (side -1) and the one at the bottom (side 1), if each is alone there and they are far enough apart."""
    g = rows.where(F.col(value).isNotNull()).groupBy(time).agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    met = rows.join(g, time).where(F.col("hi") - F.col("lo") >= least_spread)
    edge = met.where((F.col(value) == F.col("hi")) | (F.col(value) == F.col("lo")))
    side = F.when(F.col(value) == F.col("hi"), -1).otherwise(1)
    alone = edge.withColumn("side", side).groupBy(time, "side").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol"))
    return alone.where("n = 1").select(time, "symbol", "side")


def reentry(close: Column, side: Column) -> Column:
    """Signal where a bar is back within a band that the bar before was beyond: -1 below gives 1, 1 above gives -1."""
    before = F.lag(side).over(rolling.by_symbol())
    return F.when((before < 0) & (side == 0), 1).when((before > 0) & (side == 0), -1).otherwise(0)


def sign_change(x: Column) -> Column:
    """1 where a difference turns positive, -1 where it turns negative, 0 else; both neighbours must be known."""
    before = F.lag(x).over(rolling.by_symbol())
    return F.when((before <= 0) & (x > 0), 1).when((before >= 0) & (x < 0), -1).otherwise(0)


def doji_score(open_: Column, high: Column, low: Column, close: Column, atr: Column, relative_volume: Column, trend: Column, location: Column) -> Column:
    """0 to 100 by tightness .20, size .25, volume .20, trend .20 and location .15, each clipped to [0, 1]; null outside the gate (body at most a tenth of the range, range at least half the ATR)."""
    size = high - low
    share = F.abs(close - open_) / size

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))

    score = 0.20 * clip(1 - share / 0.10) + 0.25 * clip(size / atr / 2) + 0.20 * clip(relative_volume / 2) + 0.20 * clip(trend) + 0.15 * clip(location)
    return F.when((size > 0) & (share <= 0.10) & (size / atr >= 0.5), 100 * score)
