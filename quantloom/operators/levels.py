"""Price levels with validity intervals, volume profiles and anchored averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import rolling


def period_levels(trades: DataFrame, period_ms: int, valid_ms: int) -> DataFrame:
    """The high and the low of each period, valid from its end for ``valid_ms``."""
    end = F.col("ms") - F.pmod("ms", F.lit(period_ms)) + period_ms
    both = trades.groupBy("symbol", end.alias("valid_from")).agg(F.max("price").alias("high"), F.min("price").alias("low"))
    parts = [both.select("symbol", F.col(kind).alias("level"), "valid_from", (F.col("valid_from") + valid_ms).alias("valid_to"), F.lit(kind).alias("kind")) for kind in ("high", "low")]
    return parts[0].unionByName(parts[1])


def swings(candles: DataFrame, n: int, minutes: int) -> DataFrame:
    """Highs strictly above, and lows strictly below, the ``n`` candles on both sides; known at the end of the n-th candle after."""
    w = rolling.by_symbol()
    before, after = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    known = F.lead("open_ms", n).over(w) + minutes * calendar.MINUTE
    rows = candles.select(
        "symbol", "open_ms", "high", "low", (F.count("high").over(before) + F.count("high").over(after)).alias("n"), F.greatest(F.max("high").over(before), F.max("high").over(after)).alias("top"),
        F.least(F.min("low").over(before), F.min("low").over(after)).alias("bottom"), known.alias("valid_from"),
    ).where(F.col("n") == 2 * n)
    high = rows.where("high > top").select("symbol", "open_ms", F.lit("high").alias("kind"), F.col("high").alias("level"), "valid_from")
    return high.unionByName(rows.where("low < bottom").select("symbol", "open_ms", F.lit("low").alias("kind"), F.col("low").alias("level"), "valid_from"))


def round_levels(trades: DataFrame, step: int) -> DataFrame:
    """Multiples of ``step`` between the lowest and the highest price."""
    ends = trades.groupBy("symbol").agg((F.ceil(F.min("price") / step) * step).cast("long").alias("lo"), F.max("price").cast("long").alias("hi"))
    return ends.where("lo <= hi").select("symbol", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("level"))


def day_histograms(trades: DataFrame, width: float) -> DataFrame:
    """Volume per day and bin of the log price."""
    bin_ = F.floor(F.ln("price") / width).cast("long")
    return trades.groupBy("symbol", F.floor(F.col("ms") / calendar.DAY).alias("day"), bin_.alias("bin")).agg(F.sum("qty").alias("volume"))


def rolling_profiles(histograms: DataFrame, days: int) -> DataFrame:
    """Per day the volume per bin of the last ``days`` days: each day's histogram is added to the days that it counts for."""
    spread = histograms.withColumn("for", F.explode(F.sequence(F.col("day"), F.col("day") + days - 1)))
    known = histograms.select("symbol", F.col("day").alias("for")).distinct()
    return spread.join(known, ["symbol", "for"]).groupBy("symbol", "for", "bin").agg(F.sum("volume").alias("volume"))


def profile_peaks(histograms: DataFrame, days: int) -> DataFrame:
    """The fullest bin (the lowest of equals) of each rolling profile, and the profile's volume."""
    rows = rolling_profiles(histograms, days)
    best = F.max(F.struct("volume", (-F.col("bin")).alias("b"))).alias("best")
    found = rows.groupBy("symbol", "for").agg(best, F.sum("volume").alias("total"))
    return found.select("symbol", F.col("for").alias("day"), (-F.col("best.b")).alias("poc"), F.col("best.volume").alias("poc_volume"), "total")


def anchored_vwap(anchor: str, price: str = "price", qty: str = "qty") -> Column:
    """Volume-weighted average since the anchor, by running sums."""
    w = Window.partitionBy("symbol", anchor).orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(price) * F.col(qty)).over(w) / F.sum(qty).over(w)


def running_extremes(candles: DataFrame) -> DataFrame:
    """Running high and low, and whether a candle makes a new high."""
    w = rolling.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    before = rolling.by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    return candles.select("*", F.max("high").over(w).alias("highest"), F.min("low").over(w).alias("lowest"), F.coalesce(F.col("high") > F.max("high").over(before), F.lit(True)).alias("record_high"))
