"""Queries over validation, trend, paths, parity and reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import asof, bars, paths, ranks, reports, rolling, trend, validation
from .market import rounded
from .tables import DAY, FOUR_HOURLY, HOUR, HOURLY, TRADES, bars_sql, four_hourly, hourly, read, trades

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"
AS_OF = 1_706_572_800_000  # 2024-01-30
SEGMENTS = (("train", 1_704_067_200_000, 1_705_276_800_000), ("validate", 1_705_276_800_000, 1_706_140_800_000), ("hidden", 1_706_140_800_000, 1_706_745_600_000))


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("window_reasons", HOURLY + f""", l as (select *, row_number() over (partition by symbol order by open_ms desc) as k from bars where open_ms + {HOUR} <= {AS_OF}), g as (select symbol, count(*) as n, max(open_ms) as b, min(open_ms) as a, arg_min(close, open_ms) as p, arg_max(close, open_ms) as c from l where k <= 5 group by symbol),
r as (select *, case when {AS_OF} - b - {HOUR} > {2 * HOUR} then 'STALE' when n <= 4 then 'SHORT' when b - a <> {4 * HOUR} then 'GAP' end as reason from g) select symbol, reason, case when reason is null then round(100.0::double * (c - p) / p, 6) end as change from r""")
def window_reasons(spark, sf_dir):
    rows = validation.window_reason(hourly(spark, sf_dir), 4, 60, AS_OF, 2 * HOUR)
    return rows.select("symbol", "reason", rounded(F.col("change"), "change"))


@query("segments", f"with {TRADES}, s as (select id, ms, case " + " ".join(f"when ms >= {a} and ms < {b} then '{n}'" for n, a, b in SEGMENTS) + " end as segment, case " + " ".join(f"when ms + {DAY} - 1 >= {a} and ms + {DAY} - 1 < {b} then '{n}'" for n, a, b in SEGMENTS) + " end as last from trades) select id, segment, segment is not null and segment is not distinct from last as eligible from s")
def segments(spark, sf_dir):
    ms = F.col("ms")
    return trades(spark, sf_dir).select("id", validation.segment(ms, SEGMENTS).alias("segment"), validation.eligible(ms, ms + DAY, SEGMENTS).alias("eligible"))


@query("news_blackout", f"with {TRADES}, e as (select symbol, min(ms) as ts, case when min(id) % 2 = 0 then min(ms) - {DAY} else min(ms) + 1 end as seen from trades group by symbol, ms // {DAY}) select t.symbol, t.id, exists (select 1 from e where e.symbol = t.symbol and t.ms >= e.ts - 1800000 and t.ms <= e.ts + 3600000 and e.seen <= t.ms) as blackout from trades t")
def news_blackout(spark, sf_dir):
    t = trades(spark, sf_dir)
    first = t.groupBy("symbol", F.floor(F.col("ms") / DAY).alias("d")).agg(F.min("ms").alias("ts_ms"), F.min("id").alias("id"))
    seen = F.when(F.col("id") % 2 == 0, F.col("ts_ms") - DAY).otherwise(F.col("ts_ms") + 1)
    events = first.select("symbol", "ts_ms", seen.alias("first_seen_ms"))
    return validation.blackout(t.select("symbol", "id", "ms"), events, HOUR // 2, HOUR).select("symbol", "id", "blackout")


@query("fx_open_hours")
def fx_open_hours(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.select("id", "ms", validation.fx_open(F.col("ms")).alias("is_open"))


@query("session_candles")
def session_candles(spark, sf_dir):
    """Four-hour candles of open hours: a closed bucket gives none, a missing open hour voids it, a partly closed one ends early."""
    b = bars.dense(hourly(spark, sf_dir), 60).withColumn("is_open", validation.fx_open(F.col("open_ms"))).withColumn("bucket_ms", calendar.bucket(F.col("open_ms"), 240))
    here = F.col("is_open") & F.col("close").isNotNull()
    g = b.groupBy("symbol", "bucket_ms").agg(
        F.count_if("is_open").alias("open_hours"), F.count_if(here).alias("rows"), F.count_if(~F.col("is_open") & F.col("close").isNotNull()).alias("quarantined"), F.max(F.when(F.col("is_open"), F.col("open_ms"))).alias("last_open"),
        F.min_by("open", F.when(here, F.col("open_ms"))).alias("o"), F.max(F.when(here, F.col("high"))).alias("h"), F.min(F.when(here, F.col("low"))).alias("l"), F.max_by("close", F.when(here, F.col("open_ms"))).alias("c"),
    )
    valid = (F.col("rows") == F.col("open_hours")) & (F.col("rows") > 0)
    return g.where("open_hours > 0").select("symbol", F.col("bucket_ms").alias("open_ms"), (F.col("last_open") + HOUR).alias("end_ms"), valid.alias("valid"), (F.col("open_hours") < 4).alias("partial"), "quarantined", *[F.when(valid, F.col(x)).alias(y) for x, y in zip("ohlc", ("open", "high", "low", "close"), strict=True)])


@query("order_validation", "select o_orderkey, concat_ws(',', case when not (o_totalprice > 0) then 'PRICE' end, case when not (o_custkey % 50 > 0) then 'QUANTITY' end, case when o_totalprice * (o_custkey % 50) < 1000000 then 'NOTIONAL' end, case when o_orderstatus = 'F' and o_custkey % 50 > abs(o_orderkey % 40) then 'REDUCE_ONLY' end) as reasons from orders")
def order_validation(spark, sf_dir):
    q = F.col("o_custkey") % 50
    reasons = validation.order_reasons(F.col("o_totalprice"), q, F.lit(1_000_000), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 40)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query("compatibility", "select p_partkey, concat_ws(',', case when p_size % 2 <> 0 then 'MISSING_bars' end, case when p_size % 3 <> 0 then 'MISSING_funding' end, case when p_size % 5 = 0 then 'EXCLUDES_fx' end) as reasons from part")
def compatibility(spark, sf_dir):
    s = F.col("p_size")
    has = F.array_compact(F.array(F.when(s % 2 == 0, F.lit("bars")), F.when(s % 3 == 0, F.lit("funding")), F.when(s % 5 == 0, F.lit("fx"))))
    reasons = validation.compatibility(has, F.array(F.lit("funding"), F.lit("bars")), F.array(F.lit("fx")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


@query("freshness", f"with {TRADES}, l as (select symbol, max(ms) as last from trades group by symbol) select symbol, case when {AS_OF} - last <= {HOUR} then 'fresh' when {AS_OF} - last <= {DAY} then 'aging' else 'stale' end as grade from l")
def freshness(spark, sf_dir):
    last = trades(spark, sf_dir).groupBy("symbol").agg(F.max("ms").alias("last"))
    return last.select("symbol", validation.freshness(F.lit(AS_OF) - F.col("last"), HOUR, DAY).alias("grade"))


_DAILY = "with " + TRADES + ",\n" + bars_sql("bars", 1440)


def _daily(spark, sf_dir):
    return bars.minute_bars(trades(spark, sf_dir), 1440)


@query("tsmom_signal", _DAILY + f" select symbol, open_ms, cast(sign(ln(close / lag(close, 5) over ({W}))) as double) as signal from bars")
def tsmom_signal(spark, sf_dir):
    return _daily(spark, sf_dir).select("symbol", "open_ms", trend.tsmom(F.col("close"), 5).alias("signal"))


@query("ma_score", _DAILY + f""", a as (select symbol, open_ms, close, case when count(*) over x = 3 then avg(close) over x end as m3, case when count(*) over y = 6 then avg(close) over y end as m6, case when count(*) over z = 9 then avg(close) over z end as m9 from bars window x as ({W} rows 2 preceding), y as ({W} rows 5 preceding), z as ({W} rows 8 preceding))
select symbol, open_ms, round((sign(close - m3) + sign(close - m6) + sign(close - m9)) / 3.0::double, 6) as score from a""")
def ma_score(spark, sf_dir):
    return _daily(spark, sf_dir).select("symbol", "open_ms", rounded(trend.ma_score(F.col("close"), (3, 6, 9)), "score"))


_TREND = _DAILY + f""", r as (select symbol, open_ms, close, ln(close / lag(close) over ({W})) as lr, close / lag(close) over ({W}) - 1 as ret, sign(ln(close / lag(close, 5) over ({W}))) as signal from bars),
s as (select *, case when count(lr) over w = 8 then stddev_samp(lr) over w end as sigma from r window w as ({W} rows 7 preceding)),
t as (select *, case when sigma > 0 then greatest(-2.0::double, least(2.0::double, signal * 0.2::double / sigma)) end as weight from s),
n as (select symbol, open_ms, weight, lag(weight) over ({W}) * ret - 0.001::double * abs(lag(weight) over ({W}) - coalesce(lag(weight, 2) over ({W}), 0)) - lag(weight) over ({W}) * 0.0001::double as net from t)"""


def _trend(spark, sf_dir):
    c = F.col("close")
    rows = _daily(spark, sf_dir).withColumn("lr", rolling.log_return(c)).withColumn("ret", c / F.lag(c).over(rolling.by_symbol()) - 1).withColumn("signal", trend.tsmom(c, 5))
    rows = rows.withColumn("sigma", rolling.rolling_std(F.col("lr"), 8)).withColumn("weight", trend.target_weight(F.col("signal"), 0.2, F.col("sigma"))).withColumn("funding", F.lit(0.0001))
    return trend.net_returns(rows, 10.0)


@query("trend_net", _TREND + " select symbol, open_ms, round(weight, 6) as weight, round(net, 6) as net from n")
def trend_net(spark, sf_dir):
    return _trend(spark, sf_dir).select("symbol", "open_ms", rounded(F.col("weight"), "weight"), rounded(F.col("net"), "net"))


@query("trend_portfolio", _TREND + ", p as (select open_ms, round(avg(net), 5) as mean, count(*) as active from n where net is not null group by 1) select open_ms, mean, active from p")
def trend_portfolio(spark, sf_dir):
    rows = trend.portfolio(_trend(spark, sf_dir), "open_ms", "net")
    mean = _trend(spark, sf_dir).where("net is not null").groupBy("open_ms").agg(rounded(F.avg("net"), "mean", 5))
    return rows.join(mean, "open_ms").select("open_ms", "mean", "active")


@query("trend_equity")
def trend_equity(spark, sf_dir):
    return trend.equity(trend.portfolio(_trend(spark, sf_dir), "open_ms", "net"), "open_ms")


@query("stream_stats", _TREND + " select symbol, count(net) as n, round(avg(net), 6) as mean, round(stddev_samp(net), 6) as sd, round(min(net), 6) as worst, round(max(net), 6) as best from n group by symbol")
def stream_stats(spark, sf_dir):
    rows = trend.stream_stats(_trend(spark, sf_dir), ["symbol"], "net")
    return rows.select("symbol", "n", *[rounded(F.col(c), c) for c in ("mean", "sd", "worst", "best")])


@query("without_best_month", "with m as (select date_trunc('month', o_orderdate) as m, sum(cast(round(o_totalprice * 100) as bigint)) as s from orders group by 1) select cast(sum(s) as bigint) as total, cast(sum(s) - max(s) as bigint) as without_best, count(*) as months from m")
def without_best_month(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("m"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return trend.without_best_month(rows, "m", "v")


@query("circular_shift", _DAILY + f", k as (select symbol, open_ms, close, row_number() over ({W}) - 1 as k, count(*) over (partition by symbol) as n from bars) select a.symbol, a.open_ms, b.close as shifted from k a join k b on a.symbol = b.symbol and b.k = (a.k + 7) % a.n")
def circular_shift(spark, sf_dir):
    return trend.shifted(_daily(spark, sf_dir), "symbol", "open_ms", "close", 7).select("symbol", "open_ms", "shifted")


_PATH = FOUR_HOURLY + f", p as (select symbol, open_ms, close, row_number() over ({W}) as k, count(*) over (partition by symbol) as n from bars), q as (select symbol, open_ms, high, low, row_number() over ({W}) as k from bars)"


@query("first_passage", _PATH + """, h as (select p.symbol, p.open_ms, min(case when q.high >= p.close * 1.5::double then q.k - p.k end) as up, min(case when q.low <= p.close * 0.5::double then q.k - p.k end) as down from p join q on p.symbol = q.symbol and q.k between p.k + 1 and p.k + 10 where p.k + 10 <= p.n group by 1, 2)
select symbol, open_ms, up, down, cast(case when up is null and down is null then null when coalesce(up, 99) < coalesce(down, 99) then 1 when coalesce(down, 99) < coalesce(up, 99) then -1 else 0 end as int) as outcome from h""")
def first_passage(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("h", paths.ahead("high", 10)).withColumn("l", paths.ahead("low", 10)).where("h is not null")
    rows = rows.withColumn("up", paths.first_where(F.col("h"), lambda v: v >= F.col("close") * 1.5)).withColumn("down", paths.first_where(F.col("l"), lambda v: v <= F.col("close") * 0.5))
    return rows.select("symbol", "open_ms", "up", "down", paths.barrier_outcome(F.col("up"), F.col("down")).alias("outcome"))


@query("excursion_map", _PATH + """, g as (select s.w as stop, t.w as target from (select unnest([0.2, 0.4, 0.8]) as w) s cross join (select unnest([0.2, 0.4, 0.8]) as w) t),
h as (select p.symbol, p.open_ms, g.stop, g.target, min(case when q.high >= p.close * (1 + g.target::double) then q.k end) as up, min(case when q.low <= p.close * (1 - g.stop::double) then q.k end) as down from p join q on p.symbol = q.symbol and q.k between p.k + 1 and p.k + 10 cross join g where p.k + 10 <= p.n group by 1, 2, 3, 4)
select cast(stop as double) as stop, cast(target as double) as target, count(*) as n, count(*) filter (where up is not null and up < coalesce(down, 999999)) as reached, count(*) filter (where down is not null and down <= coalesce(up, 999999)) as stopped from h group by 1, 2""")
def excursion_map(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("h", paths.ahead("high", 10)).withColumn("l", paths.ahead("low", 10)).where("h is not null")
    return paths.excursion_grid(rows, F.col("h"), F.col("l"), F.col("close"), (0.2, 0.4, 0.8))


@query("cross_section_extremes", _DAILY + f""", r as (select symbol, open_ms, round(close / lag(close) over ({W}), 2) as r from bars), g as (select open_ms, max(r) as hi, min(r) as lo from r where r is not null group by 1),
e as (select r.open_ms, r.symbol, case when r.r = g.hi then -1 else 1 end as side from r join g using (open_ms) where hi - lo >= 0.5::double and (r.r = hi or r.r = lo)) select open_ms, min(symbol) as symbol, cast(side as int) as side from e group by open_ms, side having count(*) = 1""")
def cross_section_extremes(spark, sf_dir):
    c = F.col("close")
    rows = _daily(spark, sf_dir).withColumn("r", F.round(c / F.lag(c).over(rolling.by_symbol()), 2))
    return paths.cross_section_extremes(rows, "open_ms", "r", 0.5)


@query("bollinger_reversion", FOUR_HOURLY + f""", f as (select symbol, open_ms, close, count(*) over w as n, sum(close) over w as s, sum(close * close) over w as q from bars window w as ({W} rows 19 preceding)),
b as (select symbol, open_ms, case when n = 20 then case when (s - 20 * close) * (s - 20 * close) > 4 * (20 * q - s * s) then case when s - 20 * close > 0 then -1 else 1 end else 0 end end as side from f), l as (select *, lag(side) over ({W}) as p from b)
select symbol, open_ms, cast(case when p < 0 and side = 0 then 1 when p > 0 and side = 0 then -1 else 0 end as int) as signal from l""")
def bollinger_reversion(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("side", rolling.bollinger_side(F.col("close")))
    return rows.select("symbol", "open_ms", paths.reentry(F.col("close"), F.col("side")).alias("signal"))


@query("moving_average_cross", FOUR_HOURLY + f""", a as (select symbol, open_ms, case when count(*) over y = 20 then avg(close) over x - avg(close) over y end as d from bars window x as ({W} rows 4 preceding), y as ({W} rows 19 preceding)), l as (select *, lag(d) over ({W}) as p from a)
select symbol, open_ms, cast(case when p <= 0 and d > 0 then 1 when p >= 0 and d < 0 then -1 else 0 end as int) as signal from l""")
def moving_average_cross(spark, sf_dir):
    c = F.col("close")
    rows = four_hourly(spark, sf_dir).withColumn("d", rolling.rolling_mean(c, 5) - rolling.rolling_mean(c, 20))
    return rows.select("symbol", "open_ms", paths.sign_change(F.col("d")).alias("signal"))


@query("doji_score", FOUR_HOURLY + f""", a as (select symbol, open_ms, open, high, low, close, volume, avg(high - low) over w as atr, count(*) over w as n, avg(volume) over w as v, lag(close, 5) over ({W}) as c5 from bars window w as ({W} rows between 14 preceding and 1 preceding)), b as (select *, (high - low)::double as size, abs(close - open) / (high - low)::double as share from a where high > low)
select symbol, open_ms, round(100 * (0.2::double * greatest(0, least(1, 1 - share / 0.1::double)) + 0.25::double * greatest(0, least(1, size / atr / 2)) + 0.2::double * greatest(0, least(1, volume / v / 2)) + 0.2::double * greatest(0, least(1, coalesce(abs(close - c5) / atr / 3, 0)))), 6) as score from b where n = 14 and share <= 0.1::double and size / atr >= 0.5::double""")
def doji_score(spark, sf_dir):
    size = F.col("high") - F.col("low")
    frame = rolling.last_rows(14, -1)
    rows = four_hourly(spark, sf_dir).withColumn("atr", rolling.complete(F.avg(size), size, frame, 14)).withColumn("v", F.avg("volume").over(frame))
    move = F.abs(F.col("close") - F.lag("close", 5).over(rolling.by_symbol())) / F.col("atr") / 3
    score = paths.doji_score(*[F.col(c) for c in ("open", "high", "low", "close", "atr")], F.col("volume") / F.col("v"), move, F.lit(0.0))
    return rows.withColumn("score", F.round(score, 6)).where("score is not null").select("symbol", "open_ms", "score")


@query("slow_movement", HOURLY + ",\n" + """ends as (select symbol, min(open_ms) as a, max(open_ms) as b from bars group by symbol), spine as (select symbol, unnest(range(a, b + 3600000, 3600000)) as open_ms from ends), d as (select s.symbol, s.open_ms, b.close, row_number() over (partition by s.symbol order by s.open_ms) as k from spine s left join bars b on b.symbol = s.symbol and b.open_ms = s.open_ms),
r as (select a.symbol, a.open_ms, a.k, a.close / b.close::double - 1 as r from d a left join d b on a.symbol = b.symbol and b.k = a.k - 4),
h as (select a.symbol, a.open_ms, a.r, b.r as v from r a join r b on a.symbol = b.symbol and b.k between a.k - 99 and a.k - 4 and b.r is not null where a.r is not null), m as (select symbol, open_ms, r, median(v) as mid, count(*) as n from h group by 1, 2, 3), x as (select m.symbol, m.open_ms, m.r, m.mid, m.n, median(abs(h.v - m.mid)) as mad from m join h on h.symbol = m.symbol and h.open_ms = m.open_ms group by 1, 2, 3, 4, 5)
select symbol, open_ms, round((r - mid) / (1.4826::double * mad), 6) as z from x where n >= 48 and mad > 0""")
def slow_movement(spark, sf_dir):
    """Robust z of the four-hour return against earlier, disjoint four-hour returns on a dense hourly grid."""
    rows = bars.dense(hourly(spark, sf_dir), 60).withColumn("close", F.col("close").cast("double"))
    rows = rows.withColumn("r", F.col("close") / F.lag("close", 4).over(rolling.by_symbol()) - 1)
    rows = rolling.robust_z(rows, "r", rolling.by_symbol().rowsBetween(-99, -4), 48)
    return rows.where("z is not null").select("symbol", "open_ms", rounded(F.col("z"), "z"))


@query("seasonal_factors", HOURLY + f""", r as (select symbol, open_ms, power(ln(close / lag(close) over ({W})), 2) as r2, open_ms // {DAY} as d, (open_ms % {DAY}) // {6 * HOUR} as slot from bars), m as (select symbol, d, avg(r2) as mean, count(r2) as n from r group by 1, 2),
u as (select r.symbol, r.d, r.slot, avg(r.r2 / m.mean) as u from r join m on m.symbol = r.symbol and m.d = r.d where m.n >= 12 and m.mean > 0 group by 1, 2, 3),
f as (select a.symbol, a.d, a.slot, avg(b.u) as f, count(b.u) as n from u a join u b on a.symbol = b.symbol and a.slot = b.slot and b.d between a.d - 14 and a.d - 1 group by 1, 2, 3)
select symbol, d as day, slot, round(f, 6) as factor from f where n >= 5""")
def seasonal_factors(spark, sf_dir):
    """Mean share of a slot in the day's squared returns over the 14 days before, on days with 12 returns at least."""
    rows = hourly(spark, sf_dir).withColumn("r2", F.pow(rolling.log_return(F.col("close")), 2)).withColumn("day", F.floor(F.col("open_ms") / DAY)).withColumn("slot", F.floor(F.pmod("open_ms", F.lit(DAY)) / (6 * HOUR)))
    whole = Window.partitionBy("symbol", "day")
    rows = rows.withColumn("mean", F.avg("r2").over(whole)).withColumn("n", F.count("r2").over(whole)).where("n >= 12 and mean > 0")
    u = rows.groupBy("symbol", "day", "slot").agg(F.avg(F.col("r2") / F.col("mean")).alias("u"))
    w = Window.partitionBy("symbol", "slot").orderBy("day").rangeBetween(-14, -1)
    return u.select("symbol", "day", "slot", F.when(F.count("u").over(w) >= 5, F.round(F.avg("u").over(w), 6)).alias("factor")).where("factor is not null")


@query("spec_as_of", f"with r as (select s_nationkey as symbol, s_suppkey as ms, cast(round(s_acctbal * 100) as bigint) as spec from supplier), k as (select *, row_number() over (partition by symbol order by ms desc) as k from r where ms <= 60) select symbol, ms, spec from k where k = 1")
def spec_as_of(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("symbol"), F.col("s_suppkey").alias("ms"), F.round(F.col("s_acctbal") * 100).cast("long").alias("spec"))
    return reports.newest(rows.where("ms <= 60"), ["symbol"], [F.col("ms").desc()]).select("symbol", "ms", "spec")


@query("spec_changes", "with l as (select o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as p from orders) select o_custkey, o_orderkey, o_orderstatus from l where p is distinct from o_orderstatus")
def spec_changes(spark, sf_dir):
    """Rows whose content differs from the one before: what an append-only table of specs keeps."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").withColumn("p", before)
    return rows.where(~F.col("p").eqNullSafe(F.col("o_orderstatus"))).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("quotes_to_publish", f"with {TRADES}, c as (select symbol, max(ms) as ms, arg_max(price, id) as price from trades group by symbol), p as (select symbol, max(ms) as ms from trades where maker group by symbol) select c.symbol, c.ms, c.price from c left join p on p.symbol = c.symbol where p.ms is null or c.ms > p.ms")
def quotes_to_publish(spark, sf_dir):
    t = trades(spark, sf_dir)
    now = t.groupBy("symbol").agg(F.max("ms").alias("ms"), F.max_by("price", "id").alias("price"))
    sent = t.where("maker").groupBy("symbol").agg(F.max("ms").alias("sent"))
    return now.join(sent, "symbol", "left").where("sent is null or ms > sent").select("symbol", "ms", "price")


@query("missing_count", HOURLY + " select symbol, (max(open_ms) - min(open_ms)) // 3600000 + 1 - count(*) as missing from bars group by symbol")
def missing_count(spark, sf_dir):
    return bars.coverage(hourly(spark, sf_dir), 60).select("symbol", (F.col("buckets") - F.col("rows")).alias("missing"))


@query("daily_parity", _DAILY + ", f as (select symbol, open_ms - open_ms % 86400000 as d, arg_max(close, open_ms) as c, sum(volume) as v from (select symbol, ms - ms % 14400000 as open_ms, arg_max(price, id) as close, sum(qty) as volume from trades group by 1, 2) group by 1, 2) select b.symbol, count(*) as days, count(*) filter (where b.close <> f.c) as close_differs, count(*) filter (where b.volume <> f.v) as volume_differs from bars b join f on f.symbol = b.symbol and f.d = b.open_ms group by 1")
def daily_parity(spark, sf_dir):
    built = four_hourly(spark, sf_dir).groupBy("symbol", calendar.day(F.col("open_ms")).alias("open_ms")).agg(F.max_by("close", "open_ms").alias("close"), F.sum("volume").alias("volume"))
    both = bars.compare_builds(_daily(spark, sf_dir), built, ["close", "volume"])
    return both.select("symbol", F.col("matched").alias("days"), "close_differs", "volume_differs")


@query("quote_conversion", "with p(pair, price) as (values ('EURUSD', 1.25::double), ('USDJPY', 160.0::double), ('GBPUSD', 1.6::double)), q as (select n_nationkey, ['EUR', 'JPY', 'GBP', 'USD', 'CHF'][n_nationkey % 5 + 1] as ccy from nation) select n_nationkey, ccy, case when ccy = 'USD' then 1.0::double else coalesce(d.price, 1 / i.price) end as rate from q left join p d on d.pair = ccy || 'USD' left join p i on i.pair = 'USD' || ccy")
def quote_conversion(spark, sf_dir):
    prices = spark.createDataFrame([("EURUSD", 1.25), ("USDJPY", 160.0), ("GBPUSD", 1.6)], "pair string, price double")
    ccy = F.element_at(F.array(*[F.lit(c) for c in ("EUR", "JPY", "GBP", "USD", "CHF")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", ccy.alias("ccy"))
    direct = prices.select(F.col("pair").alias("dp"), F.col("price").alias("d"))
    inverse = prices.select(F.col("pair").alias("ip"), F.col("price").alias("i"))
    rows = rows.join(F.broadcast(direct), F.concat("ccy", F.lit("USD")) == F.col("dp"), "left").join(F.broadcast(inverse), F.concat(F.lit("USD"), "ccy") == F.col("ip"), "left")
    return rows.select("n_nationkey", "ccy", F.when(F.col("ccy") == "USD", 1.0).otherwise(F.coalesce("d", 1 / F.col("i"))).alias("rate"))


@query("prefix_sum_ranges", f"with {TRADES}, p as (select symbol, id, ms as b, ms - {DAY} as a from trades) select p.symbol, p.id, cast(coalesce(sum(t.qty), 0) as bigint) as bought from p left join trades t on t.symbol = p.symbol and t.ms > p.a and t.ms <= p.b and not t.maker group by 1, 2")
def prefix_sum_ranges(spark, sf_dir):
    """Taker volume in (a, b] as the difference of a running sum at both ends, by two as-of joins."""
    t = trades(spark, sf_dir)
    cells = t.groupBy("symbol", F.col("ms").alias("at_ms")).agg(F.sum(F.when(~F.col("maker"), F.col("qty")).otherwise(0)).alias("qty"))
    run = ranks.running_sum(cells, ["symbol"], "at_ms", F.col("qty"), name="run").select("symbol", "at_ms", "run")
    ends = t.select("symbol", "id", F.col("ms").alias("b"), (F.col("ms") - DAY).alias("a"))
    high = asof.asof_backward(ends, run, "symbol", "b", "at_ms", ["run"]).withColumnRenamed("run", "hi").drop("matched_at")
    both = asof.asof_backward(high, run, "symbol", "a", "at_ms", ["run"])
    return both.select("symbol", "id", (F.col("hi") - F.coalesce("run", F.lit(0))).alias("bought"))


@query("matched_controls", "with s as (select l_suppkey, l_returnflag, count(*) filter (where l_linestatus = 'F') as e, count(*) filter (where l_linestatus <> 'F') as c from lineitem group by 1, 2) select l_orderkey, l_linenumber, round(s.e / s.c::double, 9) as weight from lineitem l join s on s.l_suppkey = l.l_suppkey and s.l_returnflag = l.l_returnflag where l.l_linestatus <> 'F' and s.e > 0")
def matched_controls(spark, sf_dir):
    """Weights of controls such that each stratum weighs as much as its events."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", (F.col("l_linestatus") == "F").alias("event"))
    strata = rows.groupBy("l_suppkey", "l_returnflag").agg(F.count_if("event").alias("e"), F.count_if(~F.col("event")).alias("c"))
    return rows.where("not event").join(strata, ["l_suppkey", "l_returnflag"]).where("e > 0").select("l_orderkey", "l_linenumber", F.round(F.col("e") / F.col("c"), 9).alias("weight"))


@query("exact_match_labels", "with l as (select l_orderkey, l_linenumber, l_returnflag, max(l_shipdate) over (partition by l_orderkey) as last from lineitem) select o_orderkey, case when l.l_orderkey is null then 'NO_LABEL' when l.l_returnflag = 'R' then 'NO_TRADE' else 'MATCHED' end as status from orders left join l on l.l_orderkey = o_orderkey and l.l_linenumber = 1")
def exact_match_labels(spark, sf_dir):
    labels = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.lit(True).alias("has"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey").join(labels, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(F.col("has").isNull(), "NO_LABEL").when(F.col("l_returnflag") == "R", "NO_TRADE").otherwise("MATCHED").alias("status"))


@query("day_balanced_loss", "with d as (select cast(l_shipdate as date) as day, avg(abs(l_discount - 0.05::double)) as loss, count(*) as n from lineitem group by 1) select day, round(loss, 6) as loss, round(1 / n::double, 9) as weight from d")
def day_balanced_loss(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    return rows.agg(F.round(F.avg(F.abs(F.col("l_discount") - 0.05)), 6).alias("loss"), F.round(1 / F.count(F.lit(1)), 9).alias("weight"))
