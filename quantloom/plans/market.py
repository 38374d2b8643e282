"""Queries over bars, rolling features, as-of joins and levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, exact
from ..operators import asof, bars, levels, rolling, trailing
from .tables import DAY, DENSE, FOUR_HOURLY, HOUR, HOURLY, TRADES, bars_sql, four_hourly, hourly, read, trades

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def rounded(column, name: str, places: int = 6):
    return F.round(column, places).alias(name)


W = "partition by symbol order by open_ms"


@query("bars_ohlc", HOURLY + " select * from bars")
def bars_ohlc(spark, sf_dir):
    return hourly(spark, sf_dir)


@query("trade_id_gaps", "with " + TRADES + """, g as (select symbol, id - lag(id) over (partition by symbol order by id) as step from trades)
select symbol, count(*) filter (where step > 1) as gaps, cast(coalesce(sum(case when step > 1 then step - 1 end), 0) as bigint) as missing from g group by symbol""")
def trade_id_gaps(spark, sf_dir):
    return bars.id_gaps(trades(spark, sf_dir))


def _candle_sql(step: int, need: int, anchor: int = 0) -> str:
    return HOURLY + ",\n" + DENSE + f""",
b as (select *, open_ms - (open_ms - {anchor}) % {step} as bucket, close is not null and flags & 25 = 0 as ok,
             max(open_ms) over (partition by symbol) + 3600000 as last_end from dense),
c as (select symbol, bucket as open_ms, count(*) = {need} and bool_and(ok) as valid, arg_min(open, open_ms) as o, max(high) as h,
             min(low) as l, arg_max(close, open_ms) as cl, cast(sum(volume) as bigint) as v
      from b where bucket + {step} <= last_end group by 1, 2)
select symbol, open_ms, valid, case when valid then o end as open, case when valid then h end as high, case when valid then l end as low,
       case when valid then cl end as close, case when valid then v end as volume from c"""


@query("candles_complete_only", _candle_sql(4 * HOUR, 4))
def candles_complete_only(spark, sf_dir):
    return bars.candles(bars.dense(hourly(spark, sf_dir), 60), 240, 60)


@query("candles_weekly_monday", _candle_sql(7 * DAY, 168, 4 * DAY))
def candles_weekly_monday(spark, sf_dir):
    return bars.candles(bars.dense(hourly(spark, sf_dir), 60), 10_080, 60)


@query("dedupe_first_wins", """with r as (select o_custkey, o_orderpriority, o_orderkey, o_orderstatus,
  row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k, count(*) over (partition by o_custkey, o_orderpriority) as copies,
  min(o_orderstatus) over (partition by o_custkey, o_orderpriority) <> max(o_orderstatus) over (partition by o_custkey, o_orderpriority) as conflict from orders)
select o_custkey, o_orderpriority, o_orderkey, o_orderstatus, copies, conflict from r where k = 1""")
def dedupe_first_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return bars.first_wins(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_orderstatus"])


@query("gap_minutes", HOURLY + f""", n as (select symbol, open_ms, lead(open_ms) over ({W}) as nxt from bars)
select symbol, open_ms + 3600000 as from_ms, nxt - 3600000 as to_ms, (nxt - open_ms) // 3600000 - 1 as missing from n where nxt > open_ms + 3600000""")
def gap_minutes(spark, sf_dir):
    return bars.missing_ranges(hourly(spark, sf_dir), 60)


@query("valid_runs", HOURLY + f""", m as (select symbol, open_ms, close >= 2000 as ok from bars),
n as (select *, ok and coalesce((not lag(ok) over ({W})) or open_ms - lag(open_ms) over ({W}) <> 3600000, true) as fresh from m),
r as (select symbol, open_ms, ok, cast(sum(case when fresh then 1 else 0 end) over ({W}) as bigint) as run from n),
s as (select symbol, open_ms, case when ok then run end as run_id from r)
select symbol, open_ms, run_id, case when run_id is not null then row_number() over (partition by symbol, run_id order by open_ms) - 1 end as run_index from s""")
def valid_runs(spark, sf_dir):
    rows = bars.valid_runs(hourly(spark, sf_dir).select("symbol", "open_ms", "close"), F.col("close") >= 2000, 60)
    return rows.select("symbol", "open_ms", "run_id", F.col("run_index").cast("long").alias("run_index"))


@query("quality_prefix", HOURLY + ",\n" + DENSE + f"""
select symbol, open_ms, cast(flags as int) as flags, cast(sum(case when flags & 25 <> 0 then 1 else 0 end) over ({W}) as bigint) as bad_before,
  min(case when flags & 25 <> 0 then open_ms end) over ({W} rows between current row and unbounded following) as next_bad_ms,
  cast(bit_or(flags) over ({W} rows between 23 preceding and current row) as int) as recent_flags from dense""")
def quality_prefix(spark, sf_dir):
    rows = bars.flags_within(bars.bad_prefix(bars.dense(hourly(spark, sf_dir), 60)), 24)
    return rows.select("symbol", "open_ms", "flags", "bad_before", "next_bad_ms", "recent_flags")


@query("bar_cross_check", HOURLY + """, k as (select symbol, open_ms, case when trades = 1 then 0 else volume end as kv, taker_volume + first_id % 2 as kt from bars where volume > 20),
m as (select symbol, open_ms from bars where high > low), i as (select symbol, open_ms from bars where close > 500), p as (select symbol, open_ms from bars where taker_volume > 0)
select b.symbol, b.open_ms, cast((case when b.close is null then 1 else 0 end) + (case when k.kv is null then 2 else 0 end) + (case when k.kv <> b.volume then 4 else 0 end)
 + (case when k.kv = 0 and b.volume > 0 then 8 else 0 end) + (case when m.symbol is null then 16 else 0 end) + (case when i.symbol is null then 32 else 0 end)
 + (case when p.symbol is null then 64 else 0 end) + (case when k.kt <> b.taker_volume then 128 else 0 end) as int) as flags
from bars b left join k on k.symbol = b.symbol and k.open_ms = b.open_ms left join m on m.symbol = b.symbol and m.open_ms = b.open_ms
left join i on i.symbol = b.symbol and i.open_ms = b.open_ms left join p on p.symbol = b.symbol and p.open_ms = b.open_ms""")
def bar_cross_check(spark, sf_dir):
    b = hourly(spark, sf_dir)
    i = F.col("first_id")
    klines = b.where("volume > 20").select("symbol", "open_ms", F.when(F.col("trades") == 1, 0).otherwise(F.col("volume")).alias("volume"), (F.col("taker_volume") + i % 2).alias("taker_volume"))
    return bars.cross_check(b, klines, b.where("high > low"), b.where("close > 500"), b.where("taker_volume > 0")).select("symbol", "open_ms", "flags")


@query("compare_builds", HOURLY + """, o as (select symbol, open_ms, close + (case when first_id % 9 = 0 then 1 else 0 end) as close, volume from bars where volume > 20),
j as (select coalesce(a.symbol, o.symbol) as symbol, a.close as ac, o.close as oc, a.volume as av, o.volume as ov, a.symbol is not null as ha, o.symbol is not null as ho
      from (select * from bars where trades > 1) a full outer join o on a.symbol = o.symbol and a.open_ms = o.open_ms)
select symbol, count(*) filter (where ha and ho) as matched, count(*) filter (where not ho) as only_one, count(*) filter (where not ha) as only_other,
 count(*) filter (where ha and ho and ac is distinct from oc) as close_differs, count(*) filter (where ha and ho and av is distinct from ov) as volume_differs from j group by symbol""")
def compare_builds(spark, sf_dir):
    b = hourly(spark, sf_dir)
    i = F.col("first_id")
    other = b.where("volume > 20").withColumn("close", F.col("close") + F.when(i % 9 == 0, 1).otherwise(0))
    return bars.compare_builds(b.where("trades > 1"), other, ["close", "volume"])


_TICKS = [1, 2, 5, 10, 20, 50, 100]


@query("tick_inference", f"""with {TRADES}, d as (select symbol, price - price % (case when id % 20000 = 0 then 1 else 5 end) as price from trades), u as (select symbol, price, count(*) as n from d group by 1, 2),
c as (select unnest({_TICKS}) as tick), v as (select symbol, tick, sum(case when price % tick <> 0 then n else 0 end) as off, sum(n) as n from u, c group by 1, 2)
select symbol, cast(max(tick) as int) as tick, cast(arg_max(off, tick) as bigint) as off_tick from v where off * 10000 <= n group by symbol""")
def tick_inference(spark, sf_dir):
    fine = F.when(F.col("id") % 20000 == 0, 1).otherwise(5)
    return bars.tick_sizes(trades(spark, sf_dir).withColumn("price", F.col("price") - F.col("price") % fine), _TICKS)


@query("bar_coverage", HOURLY + f""", g as (select *, open_ms - lag(open_ms) over ({W}) as gap from bars)
select symbol, min(open_ms) as first_ms, max(open_ms) as last_ms, count(*) as rows, (max(open_ms) - min(open_ms)) // 3600000 + 1 as buckets, coalesce(max(gap), 0) as longest_gap_ms from g group by symbol""")
def bar_coverage(spark, sf_dir):
    return bars.coverage(hourly(spark, sf_dir), 60)


@query("spacing_histogram", "with " + TRADES + """, g as (select symbol, (ms - lag(ms) over (partition by symbol order by ms, id)) // 600000 as units from trades)
select symbol, units, count(*) as n from g where units is not null group by 1, 2""")
def spacing_histogram(spark, sf_dir):
    return bars.spacing_histogram(trades(spark, sf_dir), 600_000)


@query("pct_change_windows", FOUR_HOURLY + " select * from (" + " union all ".join(
    f"select symbol, open_ms, {s} as steps, case when open_ms - lag(open_ms, {s}) over ({W}) = {s} * 14400000 then round(100.0::double * (close - lag(close, {s}) over ({W})) / lag(close, {s}) over ({W}), 6) end as change from bars" for s in (1, 3, 6)) + ")")
def pct_change_windows(spark, sf_dir):
    b = four_hourly(spark, sf_dir)
    parts = [b.select("symbol", "open_ms", F.lit(s).alias("steps"), rounded(rolling.change_over(F.col("close").cast("double"), s, 240), "change")) for s in (1, 3, 6)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("true_range", FOUR_HOURLY + f" select symbol, open_ms, greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W}))) as true_range from bars")
def true_range(spark, sf_dir):
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rolling.true_range(F.col("high"), F.col("low"), F.col("close")).alias("true_range"))


@query("bollinger_breach", FOUR_HOURLY + f""", f as (select symbol, open_ms, close, count(*) over w as n, sum(close) over w as s, sum(close * close) over w as q from bars window w as ({W} rows between 19 preceding and current row))
select symbol, open_ms, cast(case when n = 20 then case when (s - 20 * close) * (s - 20 * close) > 4 * (20 * q - s * s) then case when s - 20 * close > 0 then -1 else 1 end else 0 end end as int) as side from f""")
def bollinger_breach(spark, sf_dir):
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rolling.bollinger_side(F.col("close")).alias("side"))


@query("rolling_volume_ratio", FOUR_HOURLY + f" select symbol, open_ms, case when count(*) over w = 20 then round(volume / avg(volume) over w, 6) end as ratio from bars window w as ({W} rows between 20 preceding and 1 preceding)")
def rolling_volume_ratio(spark, sf_dir):
    mean = rolling.complete(F.avg("volume"), F.col("volume"), rolling.last_rows(20, -1), 20)
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rounded(F.col("volume") / mean, "ratio"))


@query("prior_channel", FOUR_HOURLY + f" select symbol, open_ms, case when count(*) over w = 20 then max(high) over w end as highest, case when count(*) over w = 20 then min(low) over w end as lowest from bars window w as ({W} rows between 20 preceding and 1 preceding)")
def prior_channel(spark, sf_dir):
    high, _ = rolling.prior_extremes(F.col("high"), 20)
    _, low = rolling.prior_extremes(F.col("low"), 20)
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", high.alias("highest"), low.alias("lowest"))


def _rank_sql(n: int, least: float, x: str) -> str:
    return FOUR_HOURLY + f""", x as (select symbol, open_ms, {x} as x, row_number() over ({W}) as k from bars),
p as (select a.symbol, a.open_ms, a.x, count(b.x) as n, count(*) filter (where b.x <= a.x) as m from x a join x b on a.symbol = b.symbol and b.k between a.k - {n - 1} and a.k group by 1, 2, 3)
select symbol, open_ms, case when x is not null and n >= {least * n} then round(m / n, 6) end as rank from p"""


@query("trailing_rank", _rank_sql(30, 0.8, "case when volume % 6 <> 0 then volume end"))
def trailing_rank(spark, sf_dir):
    x = F.when(F.col("volume") % 6 != 0, F.col("volume"))
    return four_hourly(spark, sf_dir).withColumn("x", x).select("symbol", "open_ms", rounded(rolling.trailing_rank(F.col("x"), 30), "rank"))


@query("percentile_rank", _rank_sql(30, 1.0, "close"))
def percentile_rank(spark, sf_dir):
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rounded(rolling.percentile_rank(F.col("close"), 30), "rank"))


@query("candlestick_patterns", FOUR_HOURLY + f""", p as (select *, lag(open) over ({W}) as po, lag(close) over ({W}) as pc from bars)
select symbol, open_ms, concat_ws(',', case when high > low and abs(close - open) <= 0.1::double * (high - low) then 'doji' end,
 case when close <> open and least(open, close) - low >= 2 * abs(close - open) and high - greatest(open, close) <= abs(close - open) then 'hammer' end,
 case when close <> open and high - greatest(open, close) >= 2 * abs(close - open) and least(open, close) - low <= abs(close - open) then 'shooting_star' end,
 case when pc < po and close > open and open <= pc and close >= po then 'bullish_engulfing' end,
 case when pc > po and close < open and open >= pc and close <= po then 'bearish_engulfing' end) as patterns from p""")
def candlestick_patterns(spark, sf_dir):
    found = rolling.candle_patterns(*[F.col(c) for c in ("open", "high", "low", "close")])
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", F.array_join(found, ",").alias("patterns"))


@query("range_mean_30d", f"with {TRADES} select symbol, id, case when count(*) over w >= 5 then round(avg(price) over w, 6) end as mean from trades window w as (partition by symbol order by ms range between {30 * DAY} preceding and 1 preceding)")
def range_mean_30d(spark, sf_dir):
    """The mean of the strictly earlier 30 days; null with fewer than five rows in them."""
    rows = trailing.moving_mean(trades(spark, sf_dir).select("symbol", "id", "ms", "price"), "symbol", "ms", "price", 30 * DAY, -1)
    return rows.select("symbol", "id", F.when(F.col("n") >= 5, F.round("mean", 6)).alias("mean"))


@query("robust_z_trailing", FOUR_HOURLY + f""", h as (select a.symbol, a.open_ms, a.close as x, b.close as v from bars a join bars b on a.symbol = b.symbol and b.open_ms between a.open_ms - {7 * DAY} and a.open_ms - 1),
m as (select symbol, open_ms, x, median(v) as mid, count(*) as n from h group by 1, 2, 3), d as (select m.symbol, m.open_ms, m.x, m.mid, m.n, median(abs(h.v - m.mid)) as mad from m join h on h.symbol = m.symbol and h.open_ms = m.open_ms group by 1, 2, 3, 4, 5)
select b.symbol, b.open_ms, case when d.n >= 20 and d.mad > 0 then round((d.x - d.mid) / (1.4826::double * d.mad), 6) end as z from bars b left join d on d.symbol = b.symbol and d.open_ms = b.open_ms""")
def robust_z_trailing(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("close", F.col("close").cast("double"))
    return trailing.robust_z(rows, "close", 7, 20).select("symbol", "open_ms", rounded(F.col("z"), "z"))


@query("taker_imbalance_window", FOUR_HOURLY + f" select symbol, open_ms, case when count(*) over w = 6 and sum(volume) over w > 0 then round((2.0::double * sum(taker_volume) over w - sum(volume) over w) / sum(volume) over w, 6) end as imbalance from bars window w as ({W} rows between 5 preceding and current row)")
def taker_imbalance_window(spark, sf_dir):
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rounded(rolling.taker_imbalance(F.col("taker_volume"), F.col("volume"), 6), "imbalance"))


@query("rolling_moments", FOUR_HOURLY + f""", r as (select symbol, open_ms, close, ln(close / lag(close) over ({W})) as r from bars)
select symbol, open_ms, round(r, 6) as log_return, case when count(r) over w = 20 then round(avg(r) over w, 6) end as mean, case when count(r) over w = 20 then round(stddev_samp(r) over w, 6) end as std from r window w as ({W} rows between 19 preceding and current row)""")
def rolling_moments(spark, sf_dir):
    r = F.col("r")
    rows = four_hourly(spark, sf_dir).withColumn("r", rolling.log_return(F.col("close")))
    return rows.select("symbol", "open_ms", rounded(r, "log_return"), rounded(rolling.rolling_mean(r, 20), "mean"), rounded(rolling.rolling_std(r, 20), "std"))


@query("efficiency_ratio", FOUR_HOURLY + f""", s as (select symbol, open_ms, close, abs(close - lag(close) over ({W})) as step, abs(close - lag(close, 10) over ({W})) as net from bars), p as (select *, sum(step) over w as path, count(step) over w as n from s window w as ({W} rows between 9 preceding and current row))
select symbol, open_ms, case when n = 10 and path > 0 then round(net / path, 6) end as ratio from p""")
def efficiency_ratio(spark, sf_dir):
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", rounded(rolling.efficiency_ratio(F.col("close"), 10), "ratio"))


@query("variance_ratio", FOUR_HOURLY + f""", r as (select symbol, open_ms, ln(close / lag(close) over ({W})) as r from bars),
q as (select *, case when count(r) over w = 5 then sum(r) over w end as q from r window w as ({W} rows between 4 preceding and current row)),
v as (select symbol, open_ms, case when count(q) over w = 40 then var_samp(q) over w end as top, case when count(r) over w = 40 then var_samp(r) over w end as below from q window w as ({W} rows between 39 preceding and current row))
select symbol, open_ms, case when below > 0 then round(top / (5 * below), 6) end as variance_ratio from v""")
def variance_ratio(spark, sf_dir):
    rows = rolling.variance_ratio(four_hourly(spark, sf_dir), "close", 5, 40)
    return rows.select("symbol", "open_ms", rounded(F.col("variance_ratio"), "variance_ratio"))


@query("close_features_season", FOUR_HOURLY + f""", f as (select symbol, open_ms, close, case when count(*) over s = 6 then avg(close) over s end as a, case when count(*) over g = 30 then avg(close) over g end as b, max(close) over ({W}) as top
 from bars window s as ({W} rows between 5 preceding and current row), g as ({W} rows between 29 preceding and current row))
select symbol, open_ms, round(close / top - 1, 6) as drawdown, round(close / b, 6) as mayer,
 case when a is null or b is null then null when close > a and close > b and close / top - 1 > -0.2::double then 'bull' when close < a and close < b then 'bear' else 'transition' end as season from f""")
def close_features_season(spark, sf_dir):
    rows = rolling.close_features(four_hourly(spark, sf_dir), "close", 6, 30)
    label = rolling.season(F.col("above_short"), F.col("above_long"), F.col("drawdown"))
    return rows.select("symbol", "open_ms", rounded(F.col("drawdown"), "drawdown"), rounded(F.col("mayer"), "mayer"), label.alias("season"))


@query("forward_outcomes", FOUR_HOURLY + f""", o as (select symbol, open_ms, lead(open_ms, 6) over ({W}) - open_ms = 86400000 as exact, lead(close, 6) over ({W}) / close - 1 as ret,
 max(high) over a / close - 1 as mfe, min(low) over a / close - 1 as mae from bars window a as ({W} rows between 1 following and 6 following))
select symbol, open_ms, case when exact then round(ret, 6) end as ret, case when exact then round(mfe, 6) end as mfe, case when exact then round(mae, 6) end as mae, case when exact then 'ok' when ret is null then 'end' else 'gap' end as status from o""")
def forward_outcomes(spark, sf_dir):
    rows = rolling.outcomes(four_hourly(spark, sf_dir), 6, 240)
    return rows.select("symbol", "open_ms", *[rounded(F.col(c), c) for c in ("ret", "mfe", "mae")], "status")


@query("streaks", FOUR_HOURLY + f""", d as (select symbol, open_ms, coalesce(sign(close - lag(close) over ({W})), 0) as d from bars), g as (select *, coalesce(d <> lag(d) over ({W}), true) as fresh from d),
h as (select *, sum(case when fresh then 1 else 0 end) over ({W}) as g from g) select symbol, open_ms, cast(row_number() over (partition by symbol, g order by open_ms) * d as bigint) as streak from h""")
def streaks(spark, sf_dir):
    return rolling.streak(four_hourly(spark, sf_dir), "close").select("symbol", "open_ms", "streak")


@query("slot_relative_volume", FOUR_HOURLY + """, s as (select *, (open_ms % 86400000) // 14400000 as slot, row_number() over (partition by symbol, (open_ms % 86400000) // 14400000 order by open_ms) as k from bars),
m as (select a.symbol, a.open_ms, a.volume, median(b.volume) as mid, count(b.volume) as n from s a left join s b on a.symbol = b.symbol and a.slot = b.slot and b.k between a.k - 10 and a.k - 1 group by 1, 2, 3)
select symbol, open_ms, case when n = 10 and mid > 0 then round(volume / mid, 6) end as ratio from m""")
def slot_relative_volume(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("slot", F.floor(F.pmod("open_ms", F.lit(DAY)) / (4 * HOUR)))
    mid = rolling.slot_median("volume", "slot", 10)
    return rows.withColumn("mid", mid).select("symbol", "open_ms", F.when(F.col("mid") > 0, F.round(F.col("volume") / F.col("mid"), 6)).alias("ratio"))


def _settled(spark, sf_dir):
    """Hourly closes as a second series, known from the bar's end on."""
    return hourly(spark, sf_dir).select("symbol", (F.col("open_ms") + HOUR).alias("at_ms"), F.col("close").alias("rate"))


_SETTLED = bars_sql("bars", 60) + f",\nf as (select symbol, open_ms + {HOUR} as at_ms, close as rate from bars)"


@query("asof_backward", f"""with {TRADES}, {_SETTLED} select t.symbol, t.id, f.rate, f.at_ms as matched_at from trades t asof left join f on f.symbol = t.symbol and f.at_ms <= t.ms""")
def asof_backward(spark, sf_dir):
    left = trades(spark, sf_dir).select("symbol", "id", "ms")
    return asof.asof_backward(left, _settled(spark, sf_dir), "symbol", "ms", "at_ms", ["rate"]).select("symbol", "id", "rate", "matched_at")


@query("asof_max_gap", f"""with {TRADES}, {_SETTLED}, j as (select t.symbol, t.id, t.ms, f.rate, f.at_ms from trades t asof left join f on f.symbol = t.symbol and f.at_ms <= t.ms)
select symbol, id, case when ms - at_ms <= 7200000 then rate end as rate, case when ms - at_ms <= 7200000 then at_ms end as matched_at from j""")
def asof_max_gap(spark, sf_dir):
    left = trades(spark, sf_dir).select("symbol", "id", "ms")
    return asof.asof_backward(left, _settled(spark, sf_dir), "symbol", "ms", "at_ms", ["rate"], max_gap=2 * HOUR).select("symbol", "id", "rate", "matched_at")


@query("interval_sum", f"""with {TRADES}, {_SETTLED}, p as (select symbol, id, ms as a, ms + 21600000 as b from trades)
select p.symbol, p.id, cast(coalesce(sum(f.rate), 0) as bigint) as paid, count(f.rate) as settlements from p left join f on f.symbol = p.symbol and f.at_ms > p.a and f.at_ms <= p.b group by 1, 2""")
def interval_sum(spark, sf_dir):
    spans = trades(spark, sf_dir).select("symbol", "id", F.col("ms").alias("a"), (F.col("ms") + 6 * HOUR).alias("b"))
    met = asof.interval_join(_settled(spark, sf_dir), spans, "symbol", "at_ms", "a", "b", 6 * HOUR, closed="right")
    sums = met.groupBy("symbol", "id").agg(F.sum("rate").alias("paid"), F.count("rate").alias("settlements"))
    return spans.select("symbol", "id").join(sums, ["symbol", "id"], "left").select("symbol", "id", F.coalesce("paid", F.lit(0)).alias("paid"), F.coalesce("settlements", F.lit(0)).alias("settlements"))


_LEVELS = f"""lv as (select symbol, cast(max(price) as bigint) as hi, cast(min(price) as bigint) as lo, ms - ms % {DAY} as d from trades group by symbol, ms - ms % {DAY}),
levels as (select symbol, hi as level, d + {DAY} as valid_from, d + {3 * DAY} as valid_to, 'high' as kind from lv union all select symbol, lo, d + {DAY}, d + {3 * DAY}, 'low' from lv)"""


@query("range_level_nearest", f"""with {TRADES}, {_LEVELS} select t.symbol, t.id, min(case when l.level >= t.price then l.level end) as above, max(case when l.level <= t.price then l.level end) as below, count(l.level) as valid_levels
from trades t left join levels l on l.symbol = t.symbol and t.ms >= l.valid_from and t.ms < l.valid_to group by 1, 2""")
def range_level_nearest(spark, sf_dir):
    t = trades(spark, sf_dir)
    found = levels.period_levels(t, DAY, 2 * DAY)
    return asof.nearest_levels(t.select("symbol", "id", "ms", "price"), found).select("symbol", "id", "above", "below", "valid_levels")


@query("period_levels", f"with {TRADES}, {_LEVELS} select * from levels")
def period_levels(spark, sf_dir):
    return levels.period_levels(trades(spark, sf_dir), DAY, 2 * DAY)


@query("swing_levels", FOUR_HOURLY + f""", s as (select symbol, open_ms, high, low, count(*) over b + count(*) over a as n, max(high) over b as bh, max(high) over a as ah, min(low) over b as bl, min(low) over a as al, lead(open_ms, 3) over ({W}) + 14400000 as known_ms
 from bars window b as ({W} rows between 3 preceding and 1 preceding), a as ({W} rows between 1 following and 3 following))
select symbol, open_ms, 'high' as kind, high as level, known_ms as valid_from from s where n = 6 and high > bh and high > ah union all select symbol, open_ms, 'low', low, known_ms from s where n = 6 and low < bl and low < al""")
def swing_levels(spark, sf_dir):
    return levels.swings(four_hourly(spark, sf_dir), 3, 240)


@query("round_levels", f"with {TRADES}, e as (select symbol, min(price) as lo, max(price) as hi from trades group by symbol) select symbol, unnest(range((lo + 4999) // 5000 * 5000, hi + 1, 5000)) as level from e")
def round_levels(spark, sf_dir):
    return levels.round_levels(trades(spark, sf_dir), 5000)


@query("volume_profile_poc", f"""with {TRADES}, h as (select symbol, ms // {DAY} as d, cast(floor(ln(price) / 0.05::double) as bigint) as bin, sum(qty) as v from trades group by 1, 2, 3),
r as (select a.symbol, a.d, b.bin, sum(b.v) as v from (select distinct symbol, d from h) a join h b on a.symbol = b.symbol and b.d between a.d - 6 and a.d group by 1, 2, 3),
k as (select *, row_number() over (partition by symbol, d order by v desc, bin) as k, sum(v) over (partition by symbol, d) as total from r)
select symbol, d as day, bin as poc, cast(v as bigint) as poc_volume, cast(total as bigint) as total from k where k = 1""")
def volume_profile_poc(spark, sf_dir):
    return levels.profile_peaks(levels.day_histograms(trades(spark, sf_dir), 0.05), 7)


@query("anchored_vwap", f"""with {TRADES} select symbol, id, round(sum(price * qty) over w / sum(qty) over w, 6) as vwap from trades where qty > 0 window w as (partition by symbol, ms // {7 * DAY} order by ms, id)""")
def anchored_vwap(spark, sf_dir):
    rows = trades(spark, sf_dir).where("qty > 0").withColumn("anchor", F.floor(F.col("ms") / (7 * DAY)))
    return rows.select("symbol", "id", rounded(levels.anchored_vwap("anchor"), "vwap"))


@query("running_extremes", FOUR_HOURLY + f" select symbol, open_ms, max(high) over ({W}) as highest, min(low) over ({W}) as lowest, coalesce(high > max(high) over ({W} rows between unbounded preceding and 1 preceding), true) as record_high from bars")
def running_extremes(spark, sf_dir):
    return levels.running_extremes(four_hourly(spark, sf_dir)).select("symbol", "open_ms", "highest", "lowest", "record_high")


@query("first_touch", FOUR_HOURLY + f""", e as (select symbol, first_id as id, open_ms as entry_ms, close, cast(round(close * 0.9::double) as bigint) as stop, cast(round(close * 1.1::double) as bigint) as target from bars),
h as (select e.symbol, e.id, min(case when b.low <= e.stop then b.open_ms end) as stop_ms, min(case when b.high > e.target and b.open_ms > e.entry_ms then b.open_ms end) as target_ms from e join bars b on b.symbol = e.symbol and b.open_ms >= e.entry_ms and b.open_ms < e.entry_ms + {2 * DAY} group by 1, 2)
select symbol, id, stop_ms, target_ms, case when stop_ms is null and target_ms is null then 'E' when coalesce(stop_ms, 4611686018427387904) <= coalesce(target_ms, 4611686018427387904) then 'S' else 'T' end as pess,
 case when stop_ms is null and target_ms is null then 'E' when coalesce(target_ms, 4611686018427387904) <= coalesce(stop_ms, 4611686018427387904) then 'T' else 'S' end as opt from h""")
def first_touch(spark, sf_dir):
    b = four_hourly(spark, sf_dir)
    c = F.col("close")
    entries = b.select("symbol", F.col("first_id").alias("id"), F.col("open_ms").alias("entry_ms"), F.lit(1).alias("side"), F.round(c * 0.9).cast("long").alias("stop"), F.round(c * 1.1).cast("long").alias("target"))
    return asof.first_touch(entries, b, 2 * DAY).select("symbol", "id", "stop_ms", "target_ms", "pess", "opt")


@query("breakout_summary", FOUR_HOURLY + f""", f as (select symbol, open_ms, close, case when count(*) over p = 20 then max(high) over p end as top, case when lead(open_ms, 6) over ({W}) - open_ms = 86400000 then lead(close, 6) over ({W}) / close - 1 end as ret
 from bars window p as ({W} rows between 20 preceding and 1 preceding))
select symbol, count(*) as signals, count(ret) as measured, count(*) filter (where ret > 0) as wins, round(avg(ret), 6) as mean_ret from f where close > top group by symbol""")
def breakout_summary(spark, sf_dir):
    """Trades to bars, prior-channel breakouts, their forward returns, one line per symbol."""
    rows = four_hourly(spark, sf_dir)
    high, _ = rolling.prior_extremes(F.col("high"), 20)
    rows = rolling.outcomes(rows.withColumn("top", high), 6, 240).where("close > top")
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("signals"), F.count("ret").alias("measured"), F.count_if(F.col("ret") > 0).alias("wins"), rounded(F.avg("ret"), "mean_ret")
    )


@query("exact_numbers", r"""select event_id, cast(round(value * 100) as bigint) * 1000000 as scaled, md5(concat_ws('|', event_type, cast(event_id as varchar))) as row_hash,
 sha256(concat_ws('|', cast(user_id as varchar), event_type)) as signal_id, case when event_type like '=%' or event_type like '-%' then '''' || event_type else event_type end as cell,
 (epoch_us(ts) // 1000) + (5000 - (epoch_us(ts) // 1000) % 5000) % 5000 as boundary from events""")
def exact_numbers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", exact.to_scaled(F.col("value")).cast("long").alias("scaled"), exact.row_hash(F.col("event_type"), F.col("event_id")).alias("row_hash"),
        exact.signal_id(F.col("user_id"), F.col("event_type")).alias("signal_id"), exact.neutral_csv(F.col("event_type")).alias("cell"),
        calendar.right_closed(calendar.epoch_ms(F.col("ts"))).alias("boundary"),
    )


@query("counter_words", """select event_id, cast(('0x' || substr(sha256('7|' || event_type || '|' || cast(event_id as varchar)), 1, 8)) as bigint) as top from events""")
def counter_words(spark, sf_dir):
    word = exact.counter_words(F.lit(7), F.col("event_type"), F.col("event_id"))[0]
    return read(spark, sf_dir, "events").select("event_id", F.floor(word / F.lit(2**32).cast("decimal(20,0)")).cast("long").alias("top"))


@query("calendar_fields", f"""with {TRADES} select id, cast((ms % {DAY}) // {HOUR} as int) as hour, cast(((ms - {4 * DAY}) // {DAY}) % 7 as int) as weekday, ms - (ms - {4 * DAY}) % {7 * DAY} as week_ms, epoch_ms(date_trunc('month', to_timestamp(ms / 1000) at time zone 'UTC')) as month_ms,
 case when (ms % {DAY}) // {HOUR} < 8 then 'asia' when (ms % {DAY}) // {HOUR} < 13 then 'europe' when (ms % {DAY}) // {HOUR} < 17 then 'overlap' when (ms % {DAY}) // {HOUR} < 22 then 'us' else 'late' end as session from trades""")
def calendar_fields(spark, sf_dir):
    ms = F.col("ms")
    return trades(spark, sf_dir).select("id", calendar.hour(ms).alias("hour"), calendar.weekday(ms).alias("weekday"), calendar.week_start(ms).alias("week_ms"), calendar.month_start(ms).alias("month_ms"), calendar.session(ms).alias("session"))
