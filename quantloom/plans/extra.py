"""More reads and studies, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import bars, reports, rolling, sequential, trailing
from .market import rounded
from .tables import DAY, DENSE, FOUR_HOURLY, HOUR, HOURLY, TRADES, bars_sql, four_hourly, hourly, read, trades

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("newest_candles", FOUR_HOURLY + ", r as (select symbol, open_ms, close, row_number() over (partition by symbol order by open_ms desc) as k from bars) select symbol, string_agg(cast(close as varchar), ',' order by open_ms) as closes from r where k <= 50 group by symbol")
def newest_candles(spark, sf_dir):
    """The newest 50 candles of a symbol, oldest first, as one array."""
    rows = reports.newest(four_hourly(spark, sf_dir), ["symbol"], [F.col("open_ms").desc()], 50)
    held = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("open_ms", "close"))).alias("c"))
    return held.select("symbol", F.array_join(F.transform("c", lambda x: x["close"].cast("string")), ",").alias("closes"))


@query("forward_returns_masked", HOURLY + ",\n" + DENSE + f""", b as (select symbol, open_ms, close, sum(flags) over ({W}) as bad from dense) select symbol, open_ms, case when lead(open_ms, 4) over ({W}) - open_ms = {4 * HOUR} and lead(bad, 4) over ({W}) = bad then round(lead(close, 4) over ({W}) / close - 1, 6) end as fwd from b""")
def forward_returns_masked(spark, sf_dir):
    rows = bars.dense(hourly(spark, sf_dir), 60).withColumn("bad", F.col("flags") == 1)
    return rolling.forward_returns(rows, 4, 60, "bad").select("symbol", "open_ms", rounded(F.col("fwd"), "fwd"))


@query("relative_notional", FOUR_HOURLY + f", k as (select symbol, open_ms, quote, row_number() over ({W}) as k from bars), m as (select a.symbol, a.open_ms, a.quote, median(b.quote) as mid, count(b.quote) as n from k a left join k b on a.symbol = b.symbol and b.k between a.k - 20 and a.k - 1 group by 1, 2, 3) select symbol, open_ms, case when n = 20 and mid > 0 then round(quote / mid, 6) end as rvol from m")
def relative_notional(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("quote", F.col("quote").cast("double"))
    return rows.select("symbol", "open_ms", rounded(rolling.relative_volume(F.col("quote")), "rvol"))


@query("sliding_windows", f"with {TRADES}, w as (select symbol, price, qty, id, ms, unnest(range(ms // {HOUR} * {HOUR} - {5 * HOUR}, ms + 1, {HOUR})) as start from trades) select symbol, start as start_ms, arg_max(price, id) as last, cast(sum(price * qty) as bigint) as notional, count(*) as n from w group by 1, 2")
def sliding_windows(spark, sf_dir):
    """Six-hour windows sliding by an hour."""
    rows = trades(spark, sf_dir).withColumn("ts", F.timestamp_millis("ms"))
    g = rows.groupBy("symbol", F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.max_by("price", "id").alias("last"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.unix_millis("w.start").alias("start_ms"), "last", "notional", "n")


@query("forward_labels", "with " + TRADES + ",\n" + bars_sql("bars", 1440) + f", f as (select symbol, open_ms, lead(close, h) over ({W}) / close - 1 as r, h from bars cross join (select unnest([1]) as h)), l as (select open_ms, median(r) as mid, count(r) as n, count(*) filter (where r > 0) as up, sqrt(sum(r * r)) as rv from f where r is not null group by 1) select open_ms, n, round(mid, 6) as median_return, round(up / n::double, 6) as breadth, round(rv, 6) as realized from l")
def forward_labels(spark, sf_dir):
    """Across symbols, per decision day: median, breadth and realised size of the next day's return."""
    rows = bars.minute_bars(trades(spark, sf_dir), 1440)
    rows = rows.withColumn("r", F.lead("close").over(rolling.by_symbol()) / F.col("close") - 1).where("r is not null")
    g = rows.groupBy("open_ms").agg(F.count("r").alias("n"), F.median("r").alias("mid"), F.count_if(F.col("r") > 0).alias("up"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rv"))
    return g.select("open_ms", "n", rounded(F.col("mid"), "median_return"), rounded(F.col("up") / F.col("n"), "breadth"), rounded(F.col("rv"), "realized"))


@query("quadrant_table", FOUR_HOURLY + f", q as (select case when close > lag(close) over ({W}) then 'up' else 'down' end as price, case when trades > lag(trades) over ({W}) then 'up' else 'down' end as interest, lead(close) over ({W}) / close - 1 as fwd, lag(close) over ({W}) as p from bars) select price, interest, count(*) as n, count(fwd) as measured, round(avg(fwd), 6) as mean_fwd from q where p is not null group by 1, 2")
def quadrant_table(spark, sf_dir):
    w = rolling.by_symbol()
    side = lambda c: F.when(F.col(c) > F.lag(c).over(w), "up").otherwise("down")
    rows = four_hourly(spark, sf_dir).select(side("close").alias("price"), side("trades").alias("interest"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"), F.lag("close").over(w).alias("p")).where("p is not null")
    return rows.groupBy("price", "interest").agg(F.count(F.lit(1)).alias("n"), F.count("fwd").alias("measured"), rounded(F.avg("fwd"), "mean_fwd"))


@query("day_balanced_standardizer", "with o as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d, l_quantity as x from lineitem), w as (select *, 1 / count(*) over (partition by d)::double as w from o), t as (select sum(w) as n, sum(w * x) as s, sum(w * x * x) as q from w) select l_orderkey, l_linenumber, round((x - s / n) / sqrt(q / n - (s / n) * (s / n)), 6) as z from w cross join t")
def day_balanced_standardizer(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").alias("x"))
    return rolling.standardized(rows, "d", ["x"]).select("l_orderkey", "l_linenumber", rounded(F.col("x_z"), "z"))


@query("liquidity_weighted", f"with {TRADES}, b as (select symbol, ms // {DAY} as d, arg_min(price, id) as o, arg_max(price, id) as c, sqrt(sum(price * qty)) as w from trades group by 1, 2) select d as day, count(*) as n, round(sum(w * (c / o - 1)) / sum(w), 6) as weighted from b group by 1")
def liquidity_weighted(spark, sf_dir):
    g = trades(spark, sf_dir).groupBy(F.floor(F.col("ms") / DAY).alias("day"), "symbol").agg(F.min_by("price", "id").alias("o"), F.max_by("price", "id").alias("c"), F.sqrt(F.sum(F.col("price") * F.col("qty"))).alias("w"))
    return g.groupBy("day").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("w") * (F.col("c") / F.col("o") - 1)) / F.sum("w"), "weighted"))


@query("funding_rate_mean", f"with {TRADES}, f as (select symbol, id, ms, price from trades) select symbol, id, round(avg(price) over w, 6) as mean, count(*) over w as n from f window w as (partition by symbol order by ms range between {10 * DAY} preceding and current row)")
def funding_rate_mean(spark, sf_dir):
    rows = trailing.moving_mean(trades(spark, sf_dir).select("symbol", "id", "ms", "price"), "symbol", "ms", "price", 10 * DAY)
    return rows.select("symbol", "id", F.round("mean", 6).alias("mean"), "n")


@query("session_table", f"with {TRADES}, s as (select case when (ms % {DAY}) // {HOUR} < 8 then 'asia' when (ms % {DAY}) // {HOUR} < 13 then 'europe' when (ms % {DAY}) // {HOUR} < 17 then 'overlap' when (ms % {DAY}) // {HOUR} < 22 then 'us' else 'late' end as session, symbol, price, qty from trades) select session, symbol, count(*) as n, cast(sum(qty) as bigint) as volume, round(avg(price), 4) as mean_price from s group by 1, 2")
def session_table(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("session", calendar.session(F.col("ms")))
    return rows.groupBy("session", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("volume"), rounded(F.avg("price"), "mean_price", 4))


@query("effective_trials", "with d as (select cast(l_shipdate as date) as day, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as a, sum(case when l_returnflag = 'N' then l_quantity else 0 end) as n, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as r from lineitem group by 1), c as (select (corr(a, n) + corr(a, r) + corr(n, r)) / 3 as rho from d) select round(greatest(0, least(1, rho)), 6) as rho, round(greatest(0, least(1, rho)) + (1 - greatest(0, least(1, rho))) * 3, 6) as trials from c")
def effective_trials(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    d = l.agg(*[F.sum(F.when(F.col("l_returnflag") == k, F.col("l_quantity")).otherwise(0)).alias(k.lower()) for k in "ANR"])
    rho = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.corr("a", "n") + F.corr("a", "r") + F.corr("n", "r")) / 3))
    return d.agg(rho.alias("x")).select(rounded(F.col("x"), "rho"), rounded(F.col("x") + (1 - F.col("x")) * 3, "trials"))


@query("horizon_calibration")
def horizon_calibration(spark, sf_dir):
    """The expanding median of absolute day returns completed by each bar."""
    def run(g):
        move = (g["close"].shift(-6) / g["close"] - 1).abs().tolist()
        done = (g["open_ms"] + DAY).tolist()
        return g[["symbol", "open_ms"]].assign(median=pd.Series(sequential.expanding_median(move, done, g["open_ms"].tolist(), 2 * DAY), dtype="float64"))

    return sequential.series(four_hourly(spark, sf_dir), "symbol", ["open_ms"], run, "symbol string, open_ms long, median double")


@query("limit_fills")
def limit_fills(spark, sf_dir):
    """Daily limit orders at 90 % of the first open, filled by later bars of the day."""
    rows = four_hourly(spark, sf_dir).withColumn("day", F.concat_ws("|", "symbol", F.floor(F.col("open_ms") / DAY)))

    def run(g):
        through = [int(v) if k % 2 else 0 for k, v in enumerate(g["volume"])]
        out = sequential.limit_fill(1, int(g["open"].iloc[0] * 0.9), 100, list(zip(g["high"], g["low"], g["close"], through, strict=True)))
        return pd.DataFrame([(g["day"].iloc[0], *r) for r in out], columns=["day", "bar", "quantity", "status"])

    return sequential.series(rows, "day", ["open_ms"], run, "day string, bar long, quantity long, status string")


@query("top_volume_shares", "with " + TRADES + ", s as (select symbol, sum(qty) as v from trades group by 1) select symbol, cast(v as bigint) as volume, round(v / sum(v) over (), 6) as share from s")
def top_volume_shares(spark, sf_dir):
    s = trades(spark, sf_dir).groupBy("symbol").agg(F.sum("qty").alias("volume"))
    return s.select("symbol", "volume", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy()), 6).alias("share"))
