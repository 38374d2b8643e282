"""What surrounds a row: later states, the candle before, a premium against its history. Frames over time are dealt in spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import calendar
from . import rolling

RISE, DROP, NEUTRAL = "BROAD_RISE", "BROAD_DROP", "NEUTRAL"
SPAN = 30 * calendar.DAY


def dealt(rows: DataFrame, at: str, span: int, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Rows in ``__span`` of time, with copies in the spans whose frames reach them; ``__home`` tells the row from its copies.

    A frame of up to ``behind`` before and ``ahead`` after a row holds the same rows within its span as in the
    whole series, so a task sorts a span of a key and not the key. Copies are few while frames are short against spans.
    """
    first, last = F.floor((F.col(at) - ahead) / span), F.floor((F.col(at) + behind) / span)
    spread = rows.withColumn("__span", F.explode(F.sequence(first, last)))
    return spread.withColumn("__home", F.col("__span") == F.floor(F.col(at) / span))


def settle(rows: DataFrame) -> DataFrame:
    """The rows of ``dealt`` without their copies."""
    return rows.where("__home").drop("__span", "__home")


def state_paths(states: DataFrame, key: str, at: str, state: str, step: int, steps: int, end: str, span: int = SPAN) -> DataFrame:
    """What becomes of each row's state within ``steps`` steps of time, all of which must lie before ``end``.

    CENSORED where they don't; UNAVAILABLE where a step or an end's state is missing. A direction reverses at the
    first opposite state, which is known only if every step has a state. One row per (key, at) is expected.
    """
    rows = dealt(states, at, span, ahead=steps * step)
    along = Window.partitionBy(key, "__span").orderBy(at)
    after, goal = along.rangeBetween(step, steps * step), along.rangeBetween(steps * step, steps * step)
    s = F.col(state)
    rows = rows.select(
        "*", F.count(F.lit(1)).over(after).alias("__steps"), F.count(s).over(after).alias("__known"), F.max(s).over(goal).alias("terminal"),
        F.min(F.when(s == RISE, F.col(at))).over(after).alias("__rise"), F.min(F.when(s == DROP, F.col(at))).over(after).alias("__drop"),
    )
    rows = settle(rows)
    outside = F.col(at) + steps * step >= F.col(end)
    missing = (F.col("__steps") < steps) | s.isNull() | F.col("terminal").isNull()
    status = F.when(outside, "CENSORED").when(missing, "UNAVAILABLE").otherwise("AVAILABLE")
    rows = rows.withColumn("status", status)
    ready, directed = F.col("status") == "AVAILABLE", s.isin(RISE, DROP)
    whole = F.col("__known") == steps
    opposite = F.when(s == RISE, F.col("__drop")).otherwise(F.col("__rise"))
    t = F.col("terminal")
    reversal = F.when(~ready, F.col("status")).when(~directed, "NOT_APPLICABLE").when(~whole, "UNAVAILABLE").when(opposite.isNotNull(), "OBSERVED_REVERSAL").otherwise("CENSORED_NO_REVERSAL")
    return rows.select(
        key, at, F.when(~outside & (F.col("__steps") == steps), s).alias("initial"), F.when(~outside & (F.col("__steps") == steps), t).alias("terminal"), "status", F.when(ready, s == t).alias("persisted"),
        F.when(ready & directed, F.when(t == s, "PERSISTED").when(t == NEUTRAL, "WEAKENED").otherwise("REVERSED")).alias("course"), reversal.alias("reversal"),
        F.when(ready & directed & whole, opposite - F.col(at)).alias("reversal_after_ms"),
    )


def candle_before(unit: Column) -> dict[str, Column]:
    """Columns that tell of the candle before, and which side of its range this one closed on; ``unit`` measures the excess."""
    w: WindowSpec = rolling.by_symbol()
    o, h, l, c = (F.lag(n).over(w) for n in ("open", "high", "low", "close"))
    span, body, close = h - l, F.abs(c - o), F.col("close")
    side = F.when(close > h, 1).when(close < l, -1).when(c.isNotNull(), 0)
    excess = F.when(side == 1, close - h).when(side == -1, l - close)
    return {
        "prev_high": h, "prev_low": l, "prev_body_ratio": F.when(span > 0, body / span), "prev_doji": F.when(span > 0, 10 * body <= span),
        "confirm_dir": side, "confirm_excess": F.when(unit > 0, excess / unit),
    }


def whole_sum(premium: str, steps: int, step: int) -> Column:
    """The sum of the last ``steps`` steps of time, null unless each has a value."""
    frame = rolling.by_symbol().rangeBetween(-(steps - 1) * step, 0)
    return F.when(F.count(premium).over(frame) == steps, F.sum(premium).over(frame))


def unconfirmed(z: Column, move: Column, theta: float) -> Column:
    """``z`` where it is extreme and the price moved the other way, else null."""
    return F.when((F.abs(z) >= theta) & (move != 0) & (F.signum(move) != F.signum(z)), z)
