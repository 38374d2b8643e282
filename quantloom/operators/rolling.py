"""Rolling features: all of them frames over (symbol, open_ms), none looks ahead but the outcomes.

A value is null unless its window is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import calendar


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_ms")


def last_rows(n: int, end: int = 0) -> WindowSpec:
    return by_symbol().rowsBetween(end - n + 1, end)


def complete(value: Column, of: Column, frame: WindowSpec, n: int) -> Column:
    """``value`` over a frame that holds ``n`` values of ``of``, else null."""
    return F.when(F.count(of).over(frame) == n, value.over(frame))


def log_return(close: Column, lag: int = 1) -> Column:
    return F.ln(close / F.lag(close, lag).over(by_symbol()))


def rolling_mean(x: Column, n: int) -> Column:
    return complete(F.avg(x), x, last_rows(n), n)


def rolling_std(x: Column, n: int) -> Column:
    return complete(F.stddev_samp(x), x, last_rows(n), n)


def prior_extremes(x: Column, n: int) -> tuple[Column, Column]:
    """(highest, lowest) of the ``n`` rows before the current one."""
    frame = last_rows(n, -1)
    return complete(F.max(x), x, frame, n), complete(F.min(x), x, frame, n)


def trailing_rank(x: Column, n: int, least_share: float = 0.8) -> Column:
    """Share of present values in the last ``n`` rows that are at most the current one; needs ``least_share`` present."""
    held = F.collect_list(x).over(last_rows(n))
    share = F.size(F.filter(held, lambda v: v <= x)) / F.size(held)
    return F.when(x.isNotNull() & (F.size(held) >= least_share * n), share)


def percentile_rank(x: Column, n: int) -> Column:
    return trailing_rank(x, n, 1.0)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = F.lag(close).over(by_symbol())
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def bollinger_side(close: Column, n: int = 20, k: int = 2) -> Column:
    """-1 below the lower band, 1 above the upper, 0 within, without a root: S - n*c against k * sqrt(n*Q - S*S)."""
    c = close.cast("decimal(20,0)")
    frame = last_rows(n)
    total, squares = F.sum(c).over(frame), F.sum((c * c).cast("decimal(30,0)")).over(frame)
    away = (total - n * c).cast("decimal(30,0)")
    spread = (n * squares - (total.cast("decimal(19,0)") * total.cast("decimal(19,0)"))).cast("decimal(38,0)")
    beyond = (away.cast("decimal(19,0)") * away.cast("decimal(19,0)")).cast("decimal(38,0)") > k * k * spread
    side = F.when(beyond & (away > 0), -1).when(beyond & (away < 0), 1).otherwise(0)
    return F.when(F.count(close).over(frame) == n, side)


def efficiency_ratio(close: Column, n: int) -> Column:
    """Net move over the sum of moves in ``n`` steps."""
    step = F.abs(close - F.lag(close).over(by_symbol()))
    path = complete(F.sum(step), step, last_rows(n), n)
    return F.when(path > 0, F.abs(close - F.lag(close, n).over(by_symbol())) / path)


def variance_ratio(frame: DataFrame, close: str, q: int, n: int, name: str = "variance_ratio") -> DataFrame:
    """Variance of overlapping q-step log returns over q times that of single ones, in the last ``n`` rows."""
    one = log_return(F.col(close))
    rows = frame.withColumn("__r", one).withColumn("__q", complete(F.sum("__r"), F.col("__r"), last_rows(q), q))
    top = complete(F.var_samp("__q"), F.col("__q"), last_rows(n), n)
    below = complete(F.var_samp("__r"), F.col("__r"), last_rows(n), n)
    return rows.withColumn(name, F.when(below > 0, top / (q * below))).drop("__r", "__q")


def close_features(frame: DataFrame, close: str, short: int, long: int) -> DataFrame:
    """Signs against two averages, drawdown from the running high, and close over the long average."""
    c = F.col(close)
    s, g = rolling_mean(c, short), rolling_mean(c, long)
    high = F.max(c).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return frame.select("*", F.signum(c - s).alias("above_short"), F.signum(c - g).alias("above_long"), (c / high - 1).alias("drawdown"), (c / g).alias("mayer"))


def season(above_short: Column, above_long: Column, drawdown: Column) -> Column:
    both_known = above_short.isNotNull() & above_long.isNotNull()
    label = F.when((above_short > 0) & (above_long > 0) & (drawdown > -0.2), "bull").when((above_short < 0) & (above_long < 0), "bear").otherwise("transition")
    return F.when(both_known, label)


def _middle(sorted_: Column) -> Column:
    n = F.size(sorted_)
    half = F.floor(n / 2).cast("int")
    odd = F.try_element_at(sorted_, half + 1)
    return F.when(n == 0, None).when(n % 2 == 1, odd).otherwise((F.try_element_at(sorted_, F.greatest(half, F.lit(1))) + odd) / 2)


def robust_z(frame: DataFrame, x: str, window: WindowSpec, least: int, scale: float = 1.4826, name: str = "z") -> DataFrame:
    """``name``: (x - median) / (scale * MAD) over the values in ``window``; null with fewer than ``least`` or no spread."""
    rows = frame.withColumn("__held", F.sort_array(F.collect_list(x).over(window)))
    rows = rows.withColumn("__mid", _middle(F.col("__held")))
    rows = rows.withColumn("__off", F.sort_array(F.zip_with("__held", F.array_repeat("__mid", F.size("__held")), lambda v, m: F.abs(v - m))))
    rows = rows.withColumn("__mad", _middle(F.col("__off")))
    z = F.when((F.size("__held") >= least) & (F.col("__mad") > 0), (F.col(x) - F.col("__mid")) / (scale * F.col("__mad")))
    return rows.withColumn(name, z).drop("__held", "__mid", "__off", "__mad")


def earlier(days: int) -> WindowSpec:
    """Strictly earlier rows of the last ``days`` days."""
    return by_symbol().rangeBetween(-days * calendar.DAY, -1)


def taker_imbalance(taker: Column, volume: Column, n: int) -> Column:
    """(2 * taker - volume) / volume over the last ``n`` rows."""
    frame = last_rows(n)
    total = complete(F.sum(volume), volume, frame, n)
    return F.when(total > 0, (2 * F.sum(taker).over(frame) - total) / total)


def candle_patterns(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """The names of the patterns a candle shows."""
    w = by_symbol()
    size, body = high - low, F.abs(close - open_)
    upper, lower = high - F.greatest(open_, close), F.least(open_, close) - low
    po, pc = F.lag(open_).over(w), F.lag(close).over(w)
    return F.array_compact(
        F.array(
            F.when((size > 0) & (body <= 0.1 * size), F.lit("doji")),
            F.when((body > 0) & (lower >= 2 * body) & (upper <= body), F.lit("hammer")),
            F.when((body > 0) & (upper >= 2 * body) & (lower <= body), F.lit("shooting_star")),
            F.when((pc < po) & (close > open_) & (open_ <= pc) & (close >= po), F.lit("bullish_engulfing")),
            F.when((pc > po) & (close < open_) & (open_ >= pc) & (close <= po), F.lit("bearish_engulfing")),
        )
    )


def outcomes(frame: DataFrame, steps: int, minutes: int) -> DataFrame:
    """Return, best and worst excursion over the next ``steps`` bars; null unless they follow without a gap."""
    w = by_symbol()
    ahead = w.rowsBetween(1, steps)
    exact = F.lead("open_ms", steps).over(w) - F.col("open_ms") == steps * minutes * calendar.MINUTE
    c = F.col("close")
    made = [(F.lead("close", steps).over(w) / c - 1).alias("ret"), (F.max("high").over(ahead) / c - 1).alias("mfe"), (F.min("low").over(ahead) / c - 1).alias("mae")]
    rows = frame.select("*", exact.alias("__exact"), *made)
    status = F.when(F.col("__exact"), "ok").when(F.col("ret").isNull(), "end").otherwise("gap")
    return rows.select(*frame.columns, *[F.when(F.col("__exact"), F.col(x)).alias(x) for x in ("ret", "mfe", "mae")], status.alias("status"))


def change_over(close: Column, steps: int, minutes: int) -> Column:
    """Percent change against the bar ``steps`` before, if that is exactly so long ago."""
    w = by_symbol()
    exact = F.col("open_ms") - F.lag("open_ms", steps).over(w) == steps * minutes * calendar.MINUTE
    before = F.lag(close, steps).over(w)
    return F.when(exact, 100 * (close - before) / before)


def streak(frame: DataFrame, close: str) -> DataFrame:
    """``streak``: rows in a row that closed in one direction, with its sign."""
    w = by_symbol()
    rows = frame.withColumn("__d", F.coalesce(F.signum(F.col(close) - F.lag(close).over(w)), F.lit(0.0)))
    rows = rows.withColumn("__g", F.sum((F.col("__d") != F.lag("__d", 1, 2.0).over(w)).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy("symbol", "__g").orderBy("open_ms"))
    return rows.withColumn("streak", (n * F.col("__d")).cast("long")).drop("__d", "__g")


def slot_median(x: str, slot: str, n: int) -> Column:
    """The median of the last ``n`` values before in the same slot of the day."""
    frame = Window.partitionBy("symbol", slot).orderBy("open_ms").rowsBetween(-n, -1)
    held = F.sort_array(F.collect_list(x).over(frame))
    return F.when(F.size(held) == n, _middle(held))


def forward_returns(frame: DataFrame, steps: int, minutes: int, bad: str) -> DataFrame:
    """``fwd``: close ``steps`` bars later over this close, null where a bar in between is missing or bad."""
    w = by_symbol()
    upto = F.sum(F.col(bad).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = frame.withColumn("__bad", upto)
    exact = F.lead("open_ms", steps).over(w) - F.col("open_ms") == steps * minutes * calendar.MINUTE
    clean = F.lead("__bad", steps).over(w) == F.col("__bad")
    return rows.withColumn("fwd", F.when(exact & clean, F.lead("close", steps).over(w) / F.col("close") - 1)).drop("__bad")


def relative_volume(notional: Column, n: int = 20) -> Column:
    """Current notional over the median of the ``n`` before."""
    held = F.sort_array(F.collect_list(notional).over(last_rows(n, -1)))
    middle = _middle(held)
    return F.when((F.size(held) == n) & (middle > 0), notional / middle)


def standardized(frame: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Each column less its day-balanced mean over its day-balanced deviation: every day weighs the same, its rows equally."""
    weight = 1 / F.count(F.lit(1)).over(Window.partitionBy(day))
    rows = frame.withColumn("__w", weight)
    sums = [F.sum(F.col("__w") * F.col(c)).alias(f"__s_{c}") for c in columns] + [F.sum(F.col("__w") * F.col(c) * F.col(c)).alias(f"__q_{c}") for c in columns]
    total = rows.agg(F.sum("__w").alias("__n"), *sums)
    out = rows.crossJoin(F.broadcast(total))  # one row of sums
    for c in columns:
        mean = F.col(f"__s_{c}") / F.col("__n")
        deviation = F.sqrt(F.col(f"__q_{c}") / F.col("__n") - mean * mean)
        out = out.withColumn(f"{c}_z", F.when(deviation > 0, (F.col(c) - mean) / deviation))
    return out.drop("__w", "__n", *[f"__{k}_{c}" for k in "sq" for c in columns])
