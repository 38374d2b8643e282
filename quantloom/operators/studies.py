"""Label grids, level events, pools, execution candidates and spans of states."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import context


def ta_score(price: Column, ema20: Column, ema50: Column, rsi: Column, pattern: Column, volume_ratio: Column) -> Column:
    """Trend up to 40, momentum 10 or 20, pattern 20, volume 20 if aligned and at or above average; null if any part is."""
    trend = F.when((price > ema20) & (ema20 > ema50), 40).when((price < ema20) & (ema20 < ema50), -40).otherwise(0)
    momentum = F.when(rsi < 30, -20).when(rsi < 45, -10).when(rsi <= 55, 0).when(rsi <= 70, 10).otherwise(20)
    side = F.signum(trend + momentum)
    volume = F.when(volume_ratio >= 1, 20 * side).otherwise(0)
    known = price.isNotNull() & ema20.isNotNull() & ema50.isNotNull() & rsi.isNotNull() & pattern.isNotNull() & volume_ratio.isNotNull()
    return F.when(known, trend + momentum + 20 * pattern + volume).cast("int")


def label_grid(entries: DataFrame, sigma: Column, tick: int, ks: Sequence[int] = (1, 2), rrs: Sequence[float] = (1.0, 1.5, 2.0, 3.0), least_ticks: int = 4) -> DataFrame:
    """A row per entry, side, k and reward:risk with stop and target on the tick lattice; status G where the stop is too narrow."""
    grid = [F.struct(F.lit(s).alias("side"), F.lit(k).alias("k"), F.lit(float(r)).alias("rr")) for s in (1, -1) for k in ks for r in rrs]
    rows = entries.withColumn("g", F.explode(F.array(*grid))).withColumn("d", F.ceil(F.col("g.k") * sigma * F.col("price") / tick))
    rows = rows.select(*entries.columns, "g.side", "g.k", "g.rr", "d")
    stop = F.col("price") - F.col("side") * F.col("d") * tick
    target = F.col("price") + F.col("side") * F.ceil(F.col("rr") * F.col("d")) * tick
    status = F.when(F.col("d").isNull(), "V").when(F.col("price") % tick != 0, "P").when(F.col("d") < least_ticks, "G").otherwise("T")
    return rows.withColumn("stop", stop.cast("long")).withColumn("target", target.cast("long")).withColumn("status", status)


def first_breaches(times: Sequence[int], marks: Sequence[float], opened: Sequence[int], levels: Sequence[float], window: int) -> list[int | None]:
    """Per level the time of the first mark at or below it in [opened, opened + window); ``times`` and ``opened`` are sorted.

    From the last time backwards, only marks below all nearer ones are held: they rise towards the past, so that
    the first mark at or below a level is found by bisection.
    """
    held: list[float] = []
    at: list[int] = []
    out: list[int | None] = [None] * len(opened)
    next_ = len(times) - 1
    for i in range(len(opened) - 1, -1, -1):
        begin = opened[i]
        while next_ >= 0 and times[next_] >= begin:
            mark = marks[next_]
            while held and held[-1] >= mark:
                held.pop()
                at.pop()
            held.append(mark)
            at.append(times[next_])
            next_ -= 1
        k = bisect_right(held, levels[i]) - 1
        if k >= 0 and at[k] < begin + window:
            out[i] = at[k]
    return out


def liquidation_scan(positions: DataFrame, marks: DataFrame, window_ms: int) -> DataFrame:
    """The first mark at or beyond each position's liquidation price while it is open; positions are (symbol, id, open_ms, side, liq).

    A task holds the positions of one span of a symbol and the lowest and highest mark of each time that they can
    meet. No pairs are made. Marks that are null or not a number breach nothing.
    """
    span = max(1, window_ms)
    extremes = marks.where("symbol is not null and ms is not null and not isnan(cast(mark as double))").groupBy("symbol", "ms").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low is not null")
    reach = context.dealt(extremes, "ms", span, ahead=span - 1).drop("__home")
    mine = positions.withColumn("__span", F.floor(F.col("open_ms") / span))
    schema = T.StructType([*positions.schema.fields, T.StructField("liquidated_ms", T.LongType())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("ms")
        times = right["ms"].to_pylist()
        parts = []
        long = pc.fill_null(pc.greater(left["side"], 0), False)
        able = pc.and_(pc.is_valid(left["open_ms"]), pc.is_valid(left["liq"]))
        for sign, chosen in ((1, pc.and_(able, long)), (-1, pc.and_(able, pc.invert(long)))):
            some = left.filter(chosen).sort_by("open_ms")
            seen, levels = (right["low"], some["liq"]) if sign > 0 else (pc.negate(right["high"]), pc.negate(some["liq"]))
            found = first_breaches(times, seen.to_pylist(), some["open_ms"].to_pylist(), levels.to_pylist(), window_ms)
            parts.append(some.select(names).append_column("liquidated_ms", pa.array(found, pa.int64())))
        rest = left.filter(pc.invert(able)).select(names)
        parts.append(rest.append_column("liquidated_ms", pa.nulls(len(rest), pa.int64())))
        return pa.concat_tables(parts)

    names = positions.columns
    return mine.groupBy("symbol", "__span").cogroup(reach.groupBy("symbol", "__span")).applyInArrow(scan, schema)


def adverse_path(path: DataFrame, key: str, order: str, value: str, side: str) -> DataFrame:
    """The rows that set a new worst value since the start: lows of a long, highs of a short."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    signed = F.col(side) * F.col(value)
    worst = F.min(signed).over(w)
    return path.withColumn("__new", worst.isNull() | (signed < worst)).where("__new").drop("__new")


def state_spans(rows: DataFrame, key: Sequence[str], order: str, state: str, step: int) -> DataFrame:
    """Islands of one state without a gap: first and last time, rows, and whether the span reaches the end of the data."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.col(state) != F.lag(state).over(w)) | (F.col(order) - F.lag(order).over(w) != step), F.lit(True))
    marked = rows.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(w)).withColumn("__last", F.max(order).over(Window.partitionBy(*key)))
    out = marked.groupBy(*key, state, "__g").agg(F.min(order).alias("from_ms"), F.max(order).alias("to_ms"), F.count(F.lit(1)).alias("rows"), F.max("__last").alias("__last"))
    return out.select(*key, state, "from_ms", "to_ms", "rows", (F.col("to_ms") == F.col("__last")).alias("censored"))


def transition_counts(rows: DataFrame, key: Sequence[str], order: str, state: str) -> DataFrame:
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(order))
    pairs = rows.select(before.alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null and from_state <> to_state")
    return pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def first_eligible(rows: DataFrame, bin_: Sequence[str], priority: Column, order: str) -> DataFrame:
    """Per calendar bin the first eligible row by priority."""
    k = F.row_number().over(Window.partitionBy(*bin_).orderBy(priority, order))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k")


def sweeps(candles: DataFrame, n: int, share: float) -> DataFrame:
    """-1 where a candle's high clears the prior ``n`` highs by ``share`` of the average range but closes below, 1 mirrored, 0 for both or none."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    frame = w.rowsBetween(-n, -1)
    top, bottom, atr, known = F.max("high").over(frame), F.min("low").over(frame), F.avg(F.col("high") - F.col("low")).over(frame), F.count("high").over(frame) == n
    rows = candles.select("*", top.alias("__t"), bottom.alias("__b"), atr.alias("__a"), known.alias("__k"))
    up = (F.col("high") > F.col("__t") + share * F.col("__a")) & (F.col("close") < F.col("__t"))
    down = (F.col("low") < F.col("__b") - share * F.col("__a")) & (F.col("close") > F.col("__b"))
    side = F.when(up & ~down, -1).when(down & ~up, 1).otherwise(0)
    return rows.withColumn("sweep", F.when(F.col("__k"), side)).drop("__t", "__b", "__a", "__k")


def causal_frontier(candidates: DataFrame, key: str) -> DataFrame:
    """(key, status, ids) of the candidates that no other of their key surely precedes.

    Candidates are (id, earliest, latest, resource, kind, available). One is surely preceded if some
    other's latest is before its earliest, that is if the least latest is. Two on the frontier that
    compete for a resource are AMBIGUOUS, but funding charges commute; an unavailable one on it makes
    the choice UNAVAILABLE.
    """
    w = Window.partitionBy(key)
    front = candidates.withColumn("__least", F.min("latest").over(w)).where(F.col("earliest") <= F.col("__least"))
    use = front.groupBy(key, "resource").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != "funding").alias("others"), F.bool_and("available").alias("available"), F.collect_list("id").alias("ids"))
    out = use.groupBy(key).agg(F.bool_and("available").alias("available"), F.bool_or((F.col("n") > 1) & (F.col("others") > 0)).alias("contested"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    status = F.when(~F.col("available"), "UNAVAILABLE").when(F.col("contested"), "AMBIGUOUS").otherwise("SELECTED")
    return out.select(key, status.alias("status"), "ids")


# -- order-dependent


def level_events(touches: Sequence[bool], far: Sequence[bool]) -> list[bool]:
    """A touch counts if the level is armed; it disarms it until price has been far away."""
    out, armed = [], True
    for touch, away in zip(touches, far, strict=True):
        out.append(touch and armed)
        armed = (armed and not touch) or away
    return out


def liquidity_pools(swings: Sequence[tuple[int, int, float]], closes: Sequence[tuple[int, float]], tolerance: float) -> list[tuple[float, int, int, int | None]]:
    """(level, members, known, broken) of clusters of swing highs within ``tolerance`` of the pool's mean; a close above breaks it. ``swings``: (known, time, level)."""
    pools: list[dict] = []
    events = sorted([(k, 0, level) for k, _, level in swings] + [(t, 1, c) for t, c in closes])
    for at, kind, value in events:
        if kind:
            for p in pools:
                if p["broken"] is None and value > p["level"]:
                    p["broken"] = at
        else:
            near = [p for p in pools if p["broken"] is None and abs(p["level"] - value) <= tolerance]
            if near:
                p = min(near, key=lambda q: (abs(q["level"] - value), q["known"]))
                p["level"] = (p["level"] * p["n"] + value) / (p["n"] + 1)
                p["n"] += 1
            else:
                pools.append(dict(level=value, n=1, known=at, broken=None))
    return [(p["level"], p["n"], p["known"], p["broken"]) for p in pools]


def overlaps(times: Sequence[int], horizon: int) -> list[bool]:
    """Whether an event falls within the horizon of the last one that did not."""
    out, last = [], None
    for t in times:
        inside = last is not None and t < last + horizon
        out.append(inside)
        last = last if inside else t
    return out
