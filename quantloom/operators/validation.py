"""Eligibility, segments, calendars and blackouts as predicates and reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import asof


def window_reason(frame: DataFrame, steps: int, minutes: int, as_of_ms: int, stale_ms: int) -> DataFrame:
    """Why a symbol's last window of ``steps`` bars can't be used, by the first of: STALE, SHORT, GAP; null if it can; and its change."""
    w = Window.partitionBy("symbol").orderBy(F.col("open_ms").desc())
    step = minutes * calendar.MINUTE
    last = frame.where(F.col("open_ms") + step <= as_of_ms).withColumn("k", F.row_number().over(w)).where(F.col("k") <= steps + 1)
    g = last.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("open_ms").alias("b"), F.min("open_ms").alias("a"), F.min_by("close", "open_ms").alias("p"), F.max_by("close", "open_ms").alias("c"))
    reason = F.when(F.lit(as_of_ms) - F.col("b") - step > stale_ms, "STALE").when(F.col("n") <= steps, "SHORT").when(F.col("b") - F.col("a") != steps * step, "GAP")
    return g.select("symbol", reason.alias("reason"), F.when(reason.isNull(), 100 * (F.col("c") - F.col("p")) / F.col("p")).alias("change"))


def segment(ms: Column, bounds: Sequence[tuple[str, int, int]]) -> Column:
    """The name of the [start, end) that holds a time, else null."""
    out = F.lit(None).cast("string")
    for name, start, end in bounds:
        out = F.when((ms >= start) & (ms < end), name).otherwise(out)
    return out


def eligible(start: Column, end: Column, bounds: Sequence[tuple[str, int, int]]) -> Column:
    """The window lies within one segment."""
    return segment(start, bounds).eqNullSafe(segment(end - 1, bounds)) & segment(start, bounds).isNotNull()


def excluded(test_start: int, test_end: int, span: int, embargo: int) -> tuple[int, int]:
    """What training must leave out around a test range: windows that reach into it, and an embargo after it."""
    return test_start - span, test_end + embargo


def allowed(start: int, end: int, tests: Sequence[tuple[int, int]], span: int, embargo: int) -> list[tuple[int, int]]:
    """The complement of the excluded ranges within [start, end)."""
    out, at = [], start
    for a, b in sorted(excluded(x, y, span, embargo) for x, y in tests):
        if a > at:
            out.append((at, min(a, end)))
        at = max(at, b)
    return out + ([(at, end)] if at < end else [])


def fx_open(ms: Column) -> Column:
    """Whether the week is open: from Sunday 17:00 to Friday 17:00 New York time."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), "America/New_York")
    day, hour = F.weekday(local), F.hour(local)
    return ~((day == 5) | ((day == 4) & (hour >= 17)) | ((day == 6) & (hour < 17)))


def blackout(points: DataFrame, events: DataFrame, before_ms: int, after_ms: int, mode: str = "tag") -> DataFrame:
    """Points (symbol, id, ms) with ``blackout``: an event of the symbol's currency, known by then, at [ts - before, ts + after].

    ``mode`` keep changes nothing but the flag's name to null, tag flags, suppress drops flagged points.
    """
    spans = events.select("symbol", (F.col("ts_ms") - before_ms).alias("__a"), (F.col("ts_ms") + after_ms + 1).alias("__b"), F.col("first_seen_ms").alias("__seen"))
    met = asof.interval_join(points.select("symbol", "id", "ms"), spans, "symbol", "ms", "__a", "__b", before_ms + after_ms + 1).where("__seen <= ms")
    hit = met.select("symbol", "id").distinct().withColumn("__hit", F.lit(True))
    rows = points.join(hit, ["symbol", "id"], "left").withColumn("blackout", F.coalesce("__hit", F.lit(False))).drop("__hit")
    if mode == "suppress":
        return rows.where("not blackout")
    return rows if mode == "tag" else rows.withColumn("blackout", F.lit(None).cast("boolean"))


def compatibility(has: Column, needs: Column, excludes: Column) -> Column:
    """Ordered reasons against a strategy: what is missing, then what it can't be used with."""
    missing = F.transform(F.array_sort(F.array_except(needs, has)), lambda x: F.concat(F.lit("MISSING_"), x))
    clash = F.transform(F.array_sort(F.array_intersect(excludes, has)), lambda x: F.concat(F.lit("EXCLUDES_"), x))
    return F.concat(missing, clash)


def freshness(age_ms: Column, fresh_ms: int, usable_ms: int) -> Column:
    return F.when(age_ms.isNull(), "unknown").when(age_ms <= fresh_ms, "fresh").when(age_ms <= usable_ms, "aging").otherwise("stale")


def order_reasons(price: Column, quantity: Column, notional_least: Column, reduce_only: Column, position: Column) -> Column:
    """Reasons against an order, in order."""
    return F.array_compact(
        F.array(
            F.when(~(price > 0), F.lit("PRICE")), F.when(~(quantity > 0), F.lit("QUANTITY")), F.when(price * quantity < notional_least, F.lit("NOTIONAL")),
            F.when(reduce_only & (quantity > F.abs(position)), F.lit("REDUCE_ONLY")),
        )
    )
