"""As-of, interval and validity joins with equi keys, never by nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], max_gap: int | None = None, strict: bool = False, span: int = calendar.DAY) -> DataFrame:
    """Each left row with the values of the latest right row at or before it (before it if ``strict``); null if older than ``max_gap``.

    Both sides become one stream and the latest right row is carried forward within spans of time, so that a
    task sorts a span of a key, whatever the key's length. What a span begins with comes from the spans before
    it, by one row a span. Of right rows at one time the one with the greatest values counts; right rows without
    a key or time match nothing, left rows without either have nulls. No pairs are made.
    """
    body = F.struct(F.col(right_time).alias("__at"), *values)
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    mine = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(body).schema[0].dataType).alias("__r"))
    other = known.select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), body.alias("__r"))
    rows = mine.unionByName(other).withColumn("__span", F.floor(F.col("__t") / span))
    side = F.col("__l").isNull().cast("int")
    order = [F.col("__t"), side if strict else -side, F.col("__r")]
    w = Window.partitionBy("__k", "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__k").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("__t is not null").groupBy("__k", "__span").agg(F.max("__r").alias("__end"))
    begun = ends.select(F.col("__k").alias("__bk"), F.col("__span").alias("__bs"), F.last("__end", ignorenulls=True).over(earlier).alias("__begun"))
    run = rows.withColumn("__run", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    met = run.join(begun, (F.col("__k") == F.col("__bk")) & (F.col("__span") == F.col("__bs")), "left").withColumn("__last", F.coalesce("__run", "__begun"))
    fresh = F.lit(True) if max_gap is None else F.col("__t") - F.col("__last.__at") <= max_gap
    return met.select("__l.*", *[F.when(fresh, F.col(f"__last.{v}")).alias(v) for v in values], F.when(fresh, F.col("__last.__at")).alias("matched_at"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, bin_size: int, closed: str = "left") -> DataFrame:
    """Pairs with point in [start, end) (``closed`` left) or (start, end] (right).

    Intervals are dealt into the bins that they touch and points into theirs; the exact bounds are checked on what meets.
    """
    spread = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    dealt = points.withColumn("__bin", F.floor(F.col(point) / bin_size))
    inside = F.expr(f"{point} >= {start} and {point} < {end}" if closed == "left" else f"{point} > {start} and {point} <= {end}")
    return dealt.join(spread, [key, "__bin"]).where(inside).drop("__bin")


def nearest_levels(points: DataFrame, levels: DataFrame, price: str = "price", bin_size: int = 86_400_000) -> DataFrame:
    """Per point (symbol, id, ms, price) the nearest valid level at or above and at or below; levels are (symbol, level, valid_from, valid_to)."""
    met = interval_join(points, levels, "symbol", "ms", "valid_from", "valid_to", bin_size)
    gap = F.col("level") - F.col(price)
    near = met.groupBy("symbol", "id").agg(F.min(F.when(gap >= 0, F.col("level"))).alias("above"), F.max(F.when(gap <= 0, F.col("level"))).alias("below"), F.count(F.lit(1)).alias("valid_levels"))
    return points.join(near, ["symbol", "id"], "left").withColumn("valid_levels", F.coalesce("valid_levels", F.lit(0)))


def first_touch(entries: DataFrame, bars: DataFrame, window_ms: int, blocks: int = 16) -> DataFrame:
    """First stop and target touch after entry.

    ``entries``: (symbol, id, entry_ms, side, stop, target), one per (symbol, id); ``bars``: (symbol, open_ms, high, low). A bar stops if it
    reaches the stop, the entry bar too; a target counts after the entry bar and only if price goes through it. Of both in one bar the pessimistic
    outcome is the stop and the optimistic one the target. Outcome E: neither within the window.

    A window is looked through by its ``blocks`` first: entries meet the extremes of each block, and bars only in
    the block of their entry and in the first later block that can touch the stop or the target.
    """
    block = max(1, window_ms // blocks)
    in_blocks = bars.select("symbol", "open_ms", "high", "low", F.floor(F.col("open_ms") / block).alias("__block"))
    extremes = in_blocks.groupBy("symbol", "__block").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    own, last = F.floor(F.col("entry_ms") / block), F.floor((F.col("entry_ms") + window_ms - 1) / block)
    sought = entries.select("symbol", "id", "entry_ms", "side", "stop", "target", own.alias("__own"))
    long = F.col("side") > 0
    stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    target = F.when(long, F.col("high") > F.col("target")).otherwise(F.col("low") < F.col("target"))
    place, later = F.col("__block"), F.col("__block") > F.col("__own")
    able = sought.withColumn("__block", F.explode(F.sequence(own, last))).join(extremes, ["symbol", "__block"]).where(stop | target)
    chosen = F.array(F.min(F.when(~later, place)), F.min(F.when(later & stop, place)), F.min(F.when(later & target, place)))
    able = able.groupBy("symbol", "id").agg(F.array_distinct(F.array_compact(chosen)).alias("__blocks"))
    met = sought.join(able, ["symbol", "id"]).withColumn("__block", F.explode("__blocks")).join(in_blocks, ["symbol", "__block"])
    met = met.where((F.col("open_ms") >= F.col("entry_ms")) & (F.col("open_ms") < F.col("entry_ms") + window_ms))
    hits = met.groupBy("symbol", "id").agg(F.min(F.when(stop, F.col("open_ms"))).alias("stop_ms"), F.min(F.when(target & (F.col("open_ms") > F.col("entry_ms")), F.col("open_ms"))).alias("target_ms"))
    far = F.lit(2**62)
    s, t = F.coalesce("stop_ms", far), F.coalesce("target_ms", far)
    none = (s == far) & (t == far)
    rows = entries.join(hits, ["symbol", "id"], "left")
    return rows.withColumn("pess", F.when(none, "E").when(s <= t, "S").otherwise("T")).withColumn("opt", F.when(none, "E").when(t <= s, "T").otherwise("S"))
