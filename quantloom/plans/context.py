"""Queries over what surrounds a row: state paths, candles before, premium signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, context, rolling, sequential, trailing
from .market import rounded
from .proofs import BARS, walk
from .tables import DAY, DENSE, FOUR_HOURLY, HOUR, HOURLY, four_hourly, hourly

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"
STEPS, THETA, REARM, COOLDOWN = 6, 2.0, 1.0, DAY


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("state_paths", f"""{HOURLY}, {DENSE},
s as (select symbol, open_ms, case when close > open then 'BROAD_RISE' when close < open then 'BROAD_DROP' when close = open then 'NEUTRAL' end as s, max(open_ms) over (partition by symbol) as e from dense where open_ms % {97 * HOUR} <> 0),
f as (select *, count(*) over a as steps, count(s) over a as known, max(s) over g as t, min(case when s = 'BROAD_RISE' then open_ms end) over a as rise, min(case when s = 'BROAD_DROP' then open_ms end) over a as fall from s
  window a as (partition by symbol order by open_ms range between {HOUR} following and {STEPS * HOUR} following), g as (partition by symbol order by open_ms range between {STEPS * HOUR} following and {STEPS * HOUR} following)),
r as (select *, case when open_ms + {STEPS * HOUR} >= e then 'CENSORED' when steps < {STEPS} or s is null or t is null then 'UNAVAILABLE' else 'AVAILABLE' end as status, case when s = 'BROAD_RISE' then fall else rise end as opposite, s in ('BROAD_RISE', 'BROAD_DROP') as directed from f)
select symbol, open_ms, case when status <> 'CENSORED' and steps = {STEPS} then s end as initial, case when status <> 'CENSORED' and steps = {STEPS} then t end as terminal, status,
  case when status = 'AVAILABLE' then s = t end as persisted,
  case when status = 'AVAILABLE' and directed then case when t = s then 'PERSISTED' when t = 'NEUTRAL' then 'WEAKENED' else 'REVERSED' end end as course,
  case when status <> 'AVAILABLE' then status when not directed then 'NOT_APPLICABLE' when known < {STEPS} then 'UNAVAILABLE' when opposite is not null then 'OBSERVED_REVERSAL' else 'CENSORED_NO_REVERSAL' end as reversal,
  case when status = 'AVAILABLE' and directed and known = {STEPS} then opposite - open_ms end as reversal_after_ms from r""")
def state_paths(spark, sf_dir):
    """Persistence and reversal of hourly directions within six hours; some boundaries are taken out."""
    d = bars.dense(hourly(spark, sf_dir), 60).where(F.col("open_ms") % (97 * HOUR) != 0)
    move = F.col("close") - F.col("open")
    s = d.select("symbol", "open_ms", F.when(move > 0, context.RISE).when(move < 0, context.DROP).when(move == 0, context.NEUTRAL).alias("state"))
    ends = s.groupBy("symbol").agg(F.max("open_ms").alias("end"))
    return context.state_paths(s.join(ends, "symbol"), "symbol", "open_ms", "state", HOUR, STEPS, "end")


@query("candle_before", FOUR_HOURLY + f", x as (select *, lag(open) over w as o, lag(high) over w as h, lag(low) over w as l, lag(close) over w as c, avg(high - low) over ({W} rows between 14 preceding and 1 preceding) as unit from bars window w as ({W})), y as (select *, case when close > h then 1 when close < l then -1 when c is not null then 0 end as side from x) select symbol, open_ms, h as prev_high, l as prev_low, case when h > l then round(abs(c - o) / (h - l), 9) end as prev_body_ratio, case when h > l then 10 * abs(c - o) <= h - l end as prev_doji, side as confirm_dir, case when unit > 0 then round(case side when 1 then close - h when -1 then l - close end / unit, 9) end as confirm_excess from y")
def candle_before(spark, sf_dir):
    unit = F.avg(F.col("high") - F.col("low")).over(rolling.by_symbol().rowsBetween(-14, -1))
    found = context.candle_before(unit)
    found |= {n: F.round(found[n], 9) for n in ("prev_body_ratio", "confirm_excess")}
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", *[c.alias(n) for n, c in found.items()])


_Z = f"""v as (select symbol, open_ms, k, close, case when count(*) over b = 2 then sum(close - 15000) over b end as v from n window b as (partition by symbol order by open_ms range between {4 * HOUR} preceding and current row)),
h as (select a.symbol, a.open_ms, a.v as x, b.v from v a join v b on b.symbol = a.symbol and b.open_ms between a.open_ms - {7 * DAY} and a.open_ms - 1 and b.v is not null),
mid as (select symbol, open_ms, x, v, median(v) over (partition by symbol, open_ms) as m, count(*) over (partition by symbol, open_ms) as c from h),
q as (select symbol, open_ms, case when any_value(c) >= 20 and median(abs(v - m)) > 0 then (any_value(x) - any_value(m)) / (1.4826::double * median(abs(v - m))) end as z from mid group by 1, 2),
p as (select v.symbol, v.open_ms, v.k, q.z, v.close - e.close as move from v left join q using (symbol, open_ms) left join v e on e.symbol = v.symbol and e.open_ms = v.open_ms - {12 * HOUR})"""
_FREE = f"(r.last is null or x.open_ms - r.last >= {COOLDOWN})"
_CROSSES = f"(x.z is not null and r.armed and r.before is not null and r.before < {THETA}::double and abs(x.z) >= {THETA}::double and {_FREE})"
_AGAINST = f"(x.z is not null and abs(x.z) >= 1.0::double and x.move <> 0 and sign(x.move) <> sign(x.z) and {_FREE})"
_START = "(x.z is not null and abs(x.z) >= 1.0::double and x.move <> 0 and sign(x.move) <> sign(x.z))"
_SIDE = "case when x.z > 0 then -1 else 1 end"


def _premium(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).select("symbol", "open_ms", "close", (F.col("close") - 15_000).alias("premium"))
    return trailing.robust_z(rows.withColumn("sum", context.whole_sum("premium", 2, 4 * HOUR)), "sum", 7, 20)


@query("premium_z", f"{BARS}, {_Z} select symbol, open_ms, round(z, 6) as z from p")
def premium_z(spark, sf_dir):
    return _premium(spark, sf_dir).select("symbol", "open_ms", rounded(F.col("z"), "z"))


@query("premium_cross", f"""{BARS}, {_Z},
{walk("true, abs(x.z), null::bigint, 0", f"case when x.z is null then r.armed when abs(x.z) < {REARM}::double then true when {_CROSSES} then false else r.armed end, abs(x.z), case when {_CROSSES} then x.open_ms else r.last end, case when {_CROSSES} then {_SIDE} else 0 end", "symbol, k, armed, before, last, signal", "p")}
select n.symbol, open_ms, signal from n join r on r.symbol = n.symbol and r.k = n.k""")
def premium_cross(spark, sf_dir):
    """Against a premium whose score crosses the threshold, armed again when it has been small, once a day at most."""
    import pandas as pd

    def cross(g):
        found = sequential.crossings(g["z"].tolist(), g["open_ms"].tolist(), THETA, REARM, COOLDOWN)
        return g[["symbol", "open_ms"]].assign(signal=pd.array([-s for s in found], dtype="int32"))

    return sequential.series(_premium(spark, sf_dir), "symbol", ["open_ms"], cross, "symbol string, open_ms long, signal int")


@query("premium_unconfirmed", f"""{BARS}, {_Z},
{walk(f"case when {_START} then x.open_ms end, case when {_START} then {_SIDE} else 0 end", f"case when {_AGAINST} then x.open_ms else r.last end, case when {_AGAINST} then {_SIDE} else 0 end", "symbol, k, last, signal", "p")}
select n.symbol, open_ms, signal from n join r on r.symbol = n.symbol and r.k = n.k""")
def premium_unconfirmed(spark, sf_dir):
    """Against an extreme premium that the price of the last twelve hours does not confirm, once a day at most."""
    import pandas as pd

    rows = _premium(spark, sf_dir)
    then = rows.select("symbol", (F.col("open_ms") + 12 * HOUR).alias("open_ms"), F.col("close").alias("then"))
    rows = rows.join(then, ["symbol", "open_ms"], "left")
    rows = rows.withColumn("z", context.unconfirmed(F.col("z"), F.col("close") - F.col("then"), 1.0))

    def fade(g):
        found = sequential.fades(g["z"].tolist(), g["open_ms"].tolist(), 1.0, float("inf"), COOLDOWN)
        return g[["symbol", "open_ms"]].assign(signal=pd.array(found, dtype="int32"))

    return sequential.series(rows, "symbol", ["open_ms"], fade, "symbol string, open_ms long, signal int")
