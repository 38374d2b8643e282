"""Bars and candles from trades, their quality and coverage.

Column names: trades (symbol, id, ms, price, qty, maker), bars (symbol, open_ms, open, high, low,
close, volume, ...). Prices and quantities are integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

#: Bar quality flags.
NO_TRADES, KLINE_MISSING, KLINE_DIFFERS, KLINE_ZERO, MARK_MISSING, INDEX_MISSING, PREMIUM_MISSING, TAKER_DIFFERS, FROM_KLINES = (1 << k for k in range(9))
COMPROMISED = NO_TRADES | KLINE_ZERO | MARK_MISSING


def minute_bars(trades: DataFrame, minutes: int = 1) -> DataFrame:
    """Bars per symbol: open and close are the prices of the smallest and largest trade id; taker volume is that of buyers who took."""
    rows = trades.withColumn("open_ms", calendar.bucket(F.col("ms"), minutes))
    taken = F.when(~F.col("maker"), F.col("qty")).otherwise(F.lit(0))
    return rows.groupBy("symbol", "open_ms").agg(
        F.min_by("price", "id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "id").alias("close"),
        F.sum("qty").alias("volume"), F.sum(taken).alias("taker_volume"), F.sum(F.col("price") * F.col("qty")).alias("quote"),
        F.count(F.lit(1)).alias("trades"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


def id_gaps(trades: DataFrame) -> DataFrame:
    """Per symbol the number of breaks in the ids and of ids missing in them."""
    step = F.col("id") - F.lag("id").over(Window.partitionBy("symbol").orderBy("id"))
    rows = trades.select("symbol", step.alias("step"))
    return rows.groupBy("symbol").agg(F.count_if(F.col("step") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).alias("missing"))


def spine(bars: DataFrame, minutes: int) -> DataFrame:
    """Every bucket from a symbol's first to its last bar."""
    step = minutes * calendar.MINUTE
    ends = bars.groupBy("symbol").agg(F.min("open_ms").alias("a"), F.max("open_ms").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("open_ms"))


def dense(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars with a row for every bucket; an empty one has nulls and flag 1. Missing values are never filled."""
    return spine(bars, minutes).join(bars, ["symbol", "open_ms"], "left").withColumn("flags", F.when(F.col("close").isNull(), NO_TRADES).otherwise(0))


def candles(bars: DataFrame, minutes: int, base_minutes: int) -> DataFrame:
    """Candles of ``minutes`` from dense bars; valid only if no bar is missing or compromised, prices null if not; a partial tail is not built."""
    need = minutes // base_minutes
    ok = F.col("close").isNotNull() & (F.col("flags").bitwiseAND(F.lit(COMPROMISED)) == 0)
    rows = bars.withColumn("ok", ok).withColumn("bucket_ms", calendar.bucket(F.col("open_ms"), minutes))
    last = F.max("open_ms").over(Window.partitionBy("symbol")) + base_minutes * calendar.MINUTE
    rows = rows.withColumn("whole", F.col("bucket_ms") + minutes * calendar.MINUTE <= last)
    out = rows.where("whole").groupBy("symbol", "bucket_ms").agg(
        ((F.count(F.lit(1)) == need) & F.bool_and("ok")).alias("valid"), F.min_by("open", "open_ms").alias("o"), F.max("high").alias("h"),
        F.min("low").alias("l"), F.max_by("close", "open_ms").alias("c"), F.sum("volume").alias("v"),
    )
    return out.select("symbol", F.col("bucket_ms").alias("open_ms"), "valid", *[F.when(F.col("valid"), F.col(a)).alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)])


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first row of each key with ``copies`` and ``conflict`` (whether any other row differs in ``values``)."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("__k", F.row_number().over(w.orderBy(*order)))
    body = F.struct(*values)
    ranked = ranked.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("conflict", F.min(body).over(w) != F.max(body).over(w))
    return ranked.where("__k = 1").drop("__k")


def cross_check(bars: DataFrame, klines: DataFrame, mark: DataFrame, index: DataFrame, premium: DataFrame) -> DataFrame:
    """Bars with ``flags`` from four series on (symbol, open_ms): what is missing or differs."""
    key = ["symbol", "open_ms"]
    joined = bars.join(klines.select(*key, F.col("volume").alias("k_volume"), F.col("taker_volume").alias("k_taker"), F.lit(True).alias("has_k")), key, "left")
    for name, other in (("mark", mark), ("index", index), ("premium", premium)):
        joined = joined.join(other.select(*key, F.lit(True).alias(f"has_{name}")).distinct(), key, "left")
    has_k = F.coalesce("has_k", F.lit(False))

    def bit(condition: Column, flag: int) -> Column:
        return F.when(condition, flag).otherwise(0)

    flags = (
        bit(F.col("close").isNull(), NO_TRADES) + bit(~has_k, KLINE_MISSING) + bit(has_k & (F.col("k_volume") != F.col("volume")), KLINE_DIFFERS)
        + bit(has_k & (F.col("k_volume") == 0) & (F.col("volume") > 0), KLINE_ZERO) + bit(F.col("has_mark").isNull(), MARK_MISSING)
        + bit(F.col("has_index").isNull(), INDEX_MISSING) + bit(F.col("has_premium").isNull(), PREMIUM_MISSING)
        + bit(has_k & (F.col("k_taker") != F.col("taker_volume")), TAKER_DIFFERS)
    )
    return joined.select(*bars.columns, flags.alias("flags"))


def compare_builds(one: DataFrame, other: DataFrame, values: Sequence[str]) -> DataFrame:
    """Counts over two builds of the same bars: matched, differing per value, and missing on either side."""
    key = ["symbol", "open_ms"]
    a = one.select(*key, F.struct(*values).alias("a"))
    both = a.join(other.select(*key, F.struct(*values).alias("b")), key, "full_outer")
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    differ = [F.count_if(here & ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))).alias(f"{v}_differs") for v in values]
    return both.groupBy("symbol").agg(F.count_if(here).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_one"), F.count_if(F.col("a").isNull()).alias("only_other"), *differ)


def bad_prefix(bars: DataFrame) -> DataFrame:
    """``bad_before``: compromised bars up to and with each row, for range tests by difference; ``next_bad_ms``: the first at or after it."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    bad = F.col("flags").bitwiseAND(F.lit(COMPROMISED)) != 0
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return bars.select("*", F.sum(bad.cast("int")).over(w).alias("bad_before"), F.first(F.when(bad, F.col("open_ms")), ignorenulls=True).over(ahead).alias("next_bad_ms"))


def flags_within(bars: DataFrame, rows: int) -> DataFrame:
    """``recent_flags``: the flags of a bar and the ``rows`` - 1 before it, united."""
    w = Window.partitionBy("symbol").orderBy("open_ms").rowsBetween(-(rows - 1), 0)
    return bars.withColumn("recent_flags", F.bit_or("flags").over(w))


def missing_ranges(bars: DataFrame, minutes: int) -> DataFrame:
    """Runs of missing buckets: first, last and their number."""
    step = minutes * calendar.MINUTE
    nxt = F.lead("open_ms").over(Window.partitionBy("symbol").orderBy("open_ms"))
    rows = bars.select("symbol", "open_ms", nxt.alias("nxt")).where(F.col("nxt") > F.col("open_ms") + step)
    return rows.select("symbol", (F.col("open_ms") + step).alias("from_ms"), (F.col("nxt") - step).alias("to_ms"), ((F.col("nxt") - F.col("open_ms")) / step - 1).cast("long").alias("missing"))


def valid_runs(rows: DataFrame, valid: Column, minutes: int) -> DataFrame:
    """``run_id`` and ``run_index`` of valid rows without a gap between them; other rows have null."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    marked = rows.withColumn("__ok", valid)
    new = F.col("__ok") & F.coalesce((~F.lag("__ok").over(w)) | (F.col("open_ms") - F.lag("open_ms").over(w) != minutes * calendar.MINUTE), F.lit(True))
    marked = marked.withColumn("__new", new).withColumn("__run", F.sum(F.col("__new").cast("int")).over(w))
    marked = marked.withColumn("run_id", F.when(F.col("__ok"), F.col("__run")))
    index = F.row_number().over(Window.partitionBy("symbol", "run_id").orderBy("open_ms")) - 1
    return marked.withColumn("run_index", F.when(F.col("__ok"), index)).drop("__ok", "__new", "__run")


def tick_sizes(prices: DataFrame, candidates: Sequence[int]) -> DataFrame:
    """Per symbol the gcd-like tick: the largest candidate that every price is a multiple of but for one in 10000."""
    counted = prices.groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("tick", F.explode(F.array(*[F.lit(int(c)) for c in candidates])))
    off = F.sum(F.when(F.pmod(F.col("price"), F.col("tick")) != 0, F.col("n")).otherwise(0))
    rows = rows.groupBy("symbol", "tick").agg(off.alias("off"), F.sum("n").alias("n"))
    return rows.where(F.col("off") * 10_000 <= F.col("n")).groupBy("symbol").agg(F.max("tick").alias("tick"), F.max_by("off", "tick").alias("off_tick"))


def coverage(bars: DataFrame, minutes: int) -> DataFrame:
    """Per symbol first, last, rows, buckets in between and the longest gap."""
    step = minutes * calendar.MINUTE
    gap = F.col("open_ms") - F.lag("open_ms").over(Window.partitionBy("symbol").orderBy("open_ms"))
    rows = bars.withColumn("gap", gap)
    return rows.groupBy("symbol").agg(
        F.min("open_ms").alias("first_ms"), F.max("open_ms").alias("last_ms"), F.count(F.lit(1)).alias("rows"),
        ((F.max("open_ms") - F.min("open_ms")) / step + 1).cast("long").alias("buckets"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap_ms"),
    )


def spacing_histogram(rows: DataFrame, unit_ms: int) -> DataFrame:
    """Counts of the spacings between neighbouring rows of a symbol, in whole units."""
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("symbol").orderBy("ms", "id"))
    return rows.select("symbol", F.floor(gap / unit_ms).alias("units")).where("units is not null").groupBy("symbol", "units").agg(F.count(F.lit(1)).alias("n"))
