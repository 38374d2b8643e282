"""Queries over recursions, cost expressions and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar, costs
from ..operators import bars, movement, ranks, sequential, stats, trailing
from .market import rounded
from .report import outcomes
from .tables import DAY, FOUR_HOURLY, HOUR, TRADES, four_hourly, read, trades

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _per_symbol(spark, sf_dir, schema: str, function):
    """``function`` over each symbol's four-hour bars, giving a frame of further columns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        extra = function(group)
        return pd.concat([group[["symbol", "open_ms"]], pd.DataFrame(extra, index=group.index)], axis=1)

    return sequential.series(four_hourly(spark, sf_dir), "symbol", ["open_ms"], run, "symbol string, open_ms long, " + schema)


def _settled(rows, places: int, *names: str):
    """Doubles rounded to digits that don't hang on the order of additions."""
    for name in names:
        rows = rows.withColumn(name, F.round(name, places))
    return rows


def _nullable(values):
    return pd.array([pd.NA if v is None else int(v) for v in values], dtype="Int64")


@query("ema", "with recursive " + TRADES + ", bars as (select symbol, ms - ms % 14400000 as open_ms, arg_max(price, id) as close from trades group by 1, 2), n as (select symbol, open_ms, close, row_number() over (partition by symbol order by open_ms) as k from bars), s as (select symbol, cast(floor(sum(close) * 1048576.0 / 9) as bigint) as e from n where k <= 9 group by symbol), r as (select symbol, cast(9 as bigint) as k, e from s union all select n.symbol, n.k, r.e + cast(floor((n.close * 1048576 - r.e) * 2 / 10.0) as bigint) from r join n on n.symbol = r.symbol and n.k = r.k + 1) select n.symbol, n.open_ms, case when n.k >= 20 then r.e end as ema from n left join r on r.symbol = n.symbol and r.k = n.k")
def ema(spark, sf_dir):
    return _per_symbol(spark, sf_dir, "ema long", lambda g: {"ema": _nullable(sequential.ema(g["close"].tolist(), 9))})


@query("wilder_atr")
def wilder_atr(spark, sf_dir):
    return _per_symbol(spark, sf_dir, "atr long", lambda g: {"atr": _nullable(sequential.atr(g["high"].tolist(), g["low"].tolist(), g["close"].tolist()))})


@query("rsi")
def rsi(spark, sf_dir):
    return _per_symbol(spark, sf_dir, "rsi double", lambda g: {"rsi": pd.Series(sequential.rsi(g["close"].tolist()), dtype="float64")})


@query("rsi_exact")
def rsi_exact(spark, sf_dir):
    def both(g):
        pair = sequential.rsi_pair(g["close"].tolist(), 14)
        return {"gain": _nullable([p and p[0] for p in pair]), "loss": _nullable([p and p[1] for p in pair])}

    return _per_symbol(spark, sf_dir, "gain long, loss long", both)


@query("macd")
def macd(spark, sf_dir):
    def both(g):
        line, signal = sequential.macd(g["close"].tolist())
        return {"line": _nullable(line), "signal": _nullable(signal)}

    return _per_symbol(spark, sf_dir, "line long, signal long", both)


@query("adx")
def adx(spark, sf_dir):
    return _settled(_per_symbol(spark, sf_dir, "adx double", lambda g: {"adx": pd.Series(sequential.adx(g["high"].tolist(), g["low"].tolist(), g["close"].tolist()), dtype="float64")}), 6, "adx")


@query("channel_states")
def channel_states(spark, sf_dir):
    return _per_symbol(spark, sf_dir, "state int", lambda g: {"state": sequential.channel_states(g["close"].tolist(), 20)})


@query("crossing_signals")
def crossing_signals(spark, sf_dir):
    def fire(g):
        close = g["close"].astype(float)
        z = (close - close.rolling(20).mean()) / close.rolling(20).std()
        return {"signal": sequential.crossings(z.tolist(), g["open_ms"].tolist(), 1.5, 0.5, DAY)}

    return _per_symbol(spark, sf_dir, "signal int", fire)


@query("hysteresis_season")
def hysteresis_season(spark, sf_dir):
    def label(g):
        up = g["close"] >= g["close"].rolling(6).mean()
        return {"label": sequential.hysteresis(["up" if u else "down" for u in up], 3)}

    return _per_symbol(spark, sf_dir, "label string", label)


@query("no_trade_band")
def no_trade_band(spark, sf_dir):
    return _settled(_per_symbol(spark, sf_dir, "weight double", lambda g: {"weight": sequential.band_path((g["close"] / g["close"].expanding().max()).tolist(), 0.1)}), 9, "weight")


@query("ewma_variance")
def ewma_variance(spark, sf_dir):
    def sigma(g):
        variance = sequential.block_variance(g["close"].tolist(), 30, 20)
        return {"sigma": [None if v is None else str(sequential.horizon_sigma(v, 6)) for v in variance]}

    return _per_symbol(spark, sf_dir, "sigma string", sigma)


@query("ewma_std")
def ewma_std(spark, sf_dir):
    import numpy as np

    return _settled(_per_symbol(spark, sf_dir, "std double", lambda g: {"std": pd.Series(sequential.ewma_std([None, *np.diff(np.log(g["close"])).tolist()], 10.0, 10), dtype="float64")}), 9, "std")


@query("baseline_alerts")
def baseline_alerts(spark, sf_dir):
    return _per_symbol(spark, sf_dir, "alert int", lambda g: {"alert": sequential.baseline_alerts(g["close"].tolist(), g["open_ms"].tolist(), 30.0, 2 * DAY)})


_CUSUM = FOUR_HOURLY + f""", x as (select symbol, open_ms, close - 10500 as v from bars), s as (select symbol, open_ms, sum(v) over ({W}) as s, sum(-v - 1000) over ({W}) as m from x)
select symbol, open_ms, cast(s - least(0, min(s) over ({W})) as double) as positive, cast(m - least(0, min(m) over ({W})) as double) as negative from s"""


@query("cusum", _CUSUM)
def cusum(spark, sf_dir):
    """Both sums are running sums of steps less the least they have been, zero included."""
    w = Window.partitionBy("symbol").orderBy("open_ms").rowsBetween(Window.unboundedPreceding, 0)
    up = F.col("close").cast("double") - 10_000.0 - 500.0
    rows = four_hourly(spark, sf_dir).withColumn("p", F.sum(up).over(w)).withColumn("n", F.sum(-up - 1000.0).over(w))
    return rows.select("symbol", "open_ms", *[(F.col(c) - F.least(F.lit(0.0), F.min(c).over(w))).alias(name) for c, name in (("p", "positive"), ("n", "negative"))])


@query("ewma_filter")
def ewma_filter(spark, sf_dir):
    return _settled(_per_symbol(spark, sf_dir, "level double", lambda g: {"level": sequential.ewma_filter(g["close"].tolist(), 4 * HOUR, float(DAY))}), 6, "level")


@query("kalman")
def kalman(spark, sf_dir):
    def both(g):
        out = sequential.kalman_trend(g["close"].astype(float).tolist(), 1.0, 0.1, 100.0)
        return {"level": [a for a, _ in out], "slope": [b for _, b in out]}

    return _settled(_per_symbol(spark, sf_dir, "level double, slope double", both), 6, "level", "slope")


@query("bocpd")
def bocpd(spark, sf_dir):
    """Run lengths of closes in units of the earlier closes' mean and deviation; null until 20 have been seen."""

    def lengths(g):
        close = g["close"].astype(float)
        z = (close - close.expanding().mean().shift(1)) / close.expanding().std().shift(1)
        z[:20] = float("nan")
        found = sequential.bocpd(z.replace([float("inf"), -float("inf")], float("nan")).tolist(), 1 / 60)
        return {"run_length": _nullable([f and f[0] for f in found]), "recent": pd.Series([f and f[1] for f in found], dtype="float64")}

    return _per_symbol(spark, sf_dir, "run_length int, recent double", lengths)


@query("pelt")
def pelt(spark, sf_dir):
    """Offline: segments of the whole series, which it is scaled by; not a feature at any time within it."""
    def ends(g):
        close = g["close"].astype(float)
        cut = set(sequential.pelt(((close - close.mean()) / close.std()).tolist(), 6.0, 5))
        return {"segment_end": [k + 1 in cut for k in range(len(g))]}

    return _per_symbol(spark, sf_dir, "segment_end boolean", ends)


@query("greedy_independent")
def greedy_independent(spark, sf_dir):
    rows = trades(spark, sf_dir).select("symbol", "id", "ms", (F.col("ms") + F.col("qty") * 600_000).alias("exit_ms"))

    def take(g):
        return g.assign(taken=sequential.greedy_independent(list(zip(g["ms"], g["exit_ms"], strict=True))))

    return sequential.series(rows, "symbol", ["ms", "id"], take, "symbol string, id long, ms long, exit_ms long, taken boolean")


@query("onset_matching")
def onset_matching(spark, sf_dir):
    def match(g):
        pairs = sequential.onset_matches(g["ms"][~g["maker"]].tolist(), g["ms"][g["maker"]].tolist(), 10 * 60_000)
        return pd.DataFrame(pairs, columns=["one_ms", "other_ms"]).astype("int64").assign(symbol=g["symbol"].iloc[0])

    return sequential.series(trades(spark, sf_dir).select("symbol", "id", "ms", "maker"), "symbol", ["ms", "id"], match, "one_ms long, other_ms long, symbol string")


@query("value_area")
def value_area(spark, sf_dir):
    """Prices that have no logarithm and bins without a volume are in no profile; a day without any volume has no area."""
    from ..operators import levels

    rows = levels.rolling_profiles(levels.day_histograms(trades(spark, sf_dir), 0.05), 7).where("bin is not null and volume is not null")

    def area(g):
        found = sequential.value_area({int(b): int(v) for b, v in zip(g["bin"], g["volume"], strict=True)})
        known = [] if found is None else [(g["symbol"].iloc[0], int(g["for"].iloc[0]), *found)]
        return pd.DataFrame(known, columns=["symbol", "day", "poc", "low", "high"])

    return rows.groupBy("symbol", "for").applyInPandas(area, "symbol string, day long, poc long, low long, high long")


def _movement_rows(spark, sf_dir):
    """Daily returns, robust z over earlier days and change of return per symbol."""
    rows = bars.minute_bars(trades(spark, sf_dir), 1440)
    w = Window.partitionBy("symbol").orderBy("open_ms")
    rows = rows.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("acceleration", F.col("ret") - F.lag("ret").over(w))
    return trailing.robust_z(rows, "ret", 20, 5, 1 / 0.6745)


@query("market_states")
def market_states(spark, sf_dir):
    return movement.classify(_movement_rows(spark, sf_dir), "open_ms", 5)


@query("episodes")
def episodes(spark, sf_dir):
    rows = movement.classify(_movement_rows(spark, sf_dir), "open_ms", 5).withColumn("market", F.lit("all"))

    def transitions(g):
        return g[["open_ms", "state"]].assign(transition=sequential.episodes(g["state"].tolist(), (g["pace"] == "accelerating").tolist(), start=1))

    return sequential.series(rows, "market", ["open_ms"], transitions, "open_ms long, state string, transition string")


@query("capped_weights")
def capped_weights(spark, sf_dir):
    daily = trades(spark, sf_dir).groupBy(calendar.day(F.col("ms")).alias("day_ms"), "symbol").agg(F.sum(F.col("price") * F.col("qty")).cast("double").alias("notional"))
    held = daily.groupBy("day_ms").agg(F.array_sort(F.collect_list(F.struct("symbol", "notional"))).alias("rows"))
    weights = movement.capped_weights(F.transform("rows", lambda r: r["notional"]))
    return held.withColumn("w", weights).select("day_ms", F.posexplode(F.arrays_zip("rows", "w")).alias("k", "z")).select("day_ms", "z.rows.symbol", F.round("z.w", 9).alias("weight"))


@query("trimmed_mean", f"with {TRADES}, r as (select symbol, price, row_number() over (partition by symbol order by price) as k, count(*) over (partition by symbol) as n from trades) select symbol, round(avg(price), 4) as mean from r where k > floor(0.1::double * n) and k <= n - floor(0.1::double * n) group by symbol")
def trimmed_mean(spark, sf_dir):
    found = ranks.trimmed_means(trades(spark, sf_dir), ["symbol"], "price", movement.TRIM)
    return found.select("symbol", rounded(F.col("mean"), "mean", 4))


@query("wallet_ledger")
def wallet_ledger(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ms = calendar.epoch_ms(F.col("o_orderdate"))
    opens = o.select(F.col("o_custkey").alias("account"), ms.alias("ms"), F.lit("open").alias("type"), F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("value"))
    one = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.struct("l_shipdate", "l_discount", "l_tax", "l_returnflag"), "l_linenumber").alias("l"))
    closed = o.join(one, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l.l_returnflag") == "R", "liquidation").otherwise("close")
    at = F.greatest(ms, calendar.epoch_ms(F.col("l.l_shipdate")))
    closes = closed.select(F.col("o_custkey").alias("account"), at.alias("ms"), kind.alias("type"), F.col("o_orderkey").alias("id"), F.round((F.col("l.l_discount") - F.col("l.l_tax")) * 10_000_000).cast("long").alias("value"))

    def step(g):
        lines = sequential.wallet(g[["ms", "type", "id", "value"]].to_dict("records"), 1_000_000_000, 100, 5)
        return pd.DataFrame(lines, columns=["ms", "type", "id", "status", "amount", "balance"]).assign(account=g["account"].iloc[0])

    return sequential.series(opens.unionByName(closes), "account", ["ms", "id"], step, "ms long, type string, id long, status string, amount long, balance long, account long")


@query("wallet_reconcile")
def wallet_reconcile(spark, sf_dir):
    """Lines whose balance is not the one before plus the amount; none in a sound ledger."""
    rows = wallet_ledger(spark, sf_dir)
    prio = F.create_map(*[F.lit(x) for kv in sequential.PRIORITY.items() for x in kv])[F.col("type")]
    w = Window.partitionBy("account").orderBy("ms", prio, "id")
    total = rows.withColumn("expected", F.lit(1_000_000_000).cast("long") + F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.groupBy("account").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("expected") != F.col("balance")).alias("differ"))


_FILL = FOUR_HOURLY + ", f as (select symbol, open_ms, case when first_id % 2 = 0 then 1 else -1 end as side, open::double as o, high::double as h, low::double as l, close::double as c, volume from bars)"


def _fills(spark, sf_dir):
    side = F.when(F.col("first_id") % 2 == 0, 1).otherwise(-1)
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", side.alias("side"), *[F.col(c).cast("double").alias(n) for c, n in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))], "volume")


@query("cost_model", _FILL + """ select symbol, open_ms, round(o + side * greatest(o * 0.0001::double, (h - l) * 0.1::double), 6) as entry,
 round(case when side > 0 then least(o * 0.99::double, o) - greatest(o * 0.0002::double, (h - l) * 0.25::double) else greatest(o * 1.01::double, o) + greatest(o * 0.0002::double, (h - l) * 0.25::double) end, 6) as stopped,
 round(o * 0.0005::double, 6) as fee, round(-side * c * 0.0003::double, 6) as funding, round((o / 10 - side * o) / (0.01::double - side), 6) as liquidation,
 round(least(side * (o - (o / 10 - side * o) / (0.01::double - side)) + 0.0125::double * (o / 10 - side * o) / (0.01::double - side), o / 10), 6) as loss from f""")
def cost_model(spark, sf_dir):
    side, o, h, l = (F.col(c) for c in ("side", "o", "h", "l"))
    stop = F.when(side > 0, o * 0.99).otherwise(o * 1.01)
    lp = costs.liquidation_price(side, o, F.lit(10))
    made = {
        "entry": costs.entry_fill(side, o, h, l), "stopped": costs.stop_fill(side, stop, o, h, l), "fee": costs.fee(o, costs.V1.taker), "funding": costs.funding_cash(side, F.col("c"), F.lit(0.0003)),
        "liquidation": lp, "loss": costs.liquidation_loss(side, o, lp, F.lit(10)),
    }
    return _fills(spark, sf_dir).select("symbol", "open_ms", *[rounded(v, k) for k, v in made.items()])


@query("max_leverage", _FILL + ", n as (select *, 0.01::double + 3 * (h - l + 1) * (1 - side * 0.01::double) / o as need from f) select symbol, open_ms, cast(case when least(20, floor(1 / need)) >= 1 then least(20, floor(1 / need)) end as int) as leverage from n")
def max_leverage(spark, sf_dir):
    return _fills(spark, sf_dir).select("symbol", "open_ms", costs.max_leverage(F.col("side"), F.col("o"), F.col("h") - F.col("l") + 1).alias("leverage"))


@query("fx_expressions", _FILL + """ select symbol, open_ms, case when side > 0 then o + 5 else o end as reference, case when side > 0 then l <= o - 100 else h + 5 >= o + 100 end as stop_hit,
 round(case when side > 0 then least(o - 100, o) - greatest(2.5::double, (h - l) * 0.1::double) else greatest(o + 100, o + 5) + greatest(2.5::double, (h - l) * 0.1::double) end, 6) as stopped,
 case when floor(1000 / ((h - l + 1) * 0.01::double) / 1000) * 1000 >= 1000 then floor(1000 / ((h - l + 1) * 0.01::double) / 1000) * 1000 end as units, round(o - side * o * 0.5::double / 10, 6) as stop_out from f""")
def fx_expressions(spark, sf_dir):
    side, o, h, l = (F.col(c) for c in ("side", "o", "h", "l"))
    stop, five = F.when(side > 0, o - 100).otherwise(o + 100), F.lit(5.0)
    return _fills(spark, sf_dir).select(
        "symbol", "open_ms", costs.fx_entry_reference(side, o, five).alias("reference"), costs.fx_stop_hit(side, stop, five, h, l).alias("stop_hit"), rounded(costs.fx_stop_fill(side, stop, o, five, h, l), "stopped"),
        costs.fx_units(F.lit(1000.0), h - l + 1, F.lit(0.01), 100_000, 0.01, 0.01).cast("double").alias("units"), rounded(costs.fx_stop_out(side, o, F.lit(10)), "stop_out"),
    )


_BRACKETS = ((0, 100_000, 0.005, 0), (100_000, 1_000_000, 0.01, 500), (1_000_000, 10**12, 0.025, 15_500))


@query("bracket_margin", _FILL + ", b(floor, cap, rate, cum) as (values (0::bigint, 100000::bigint, 0.005::double, 0::bigint), (100000, 1000000, 0.01, 500), (1000000, 1000000000000, 0.025, 15500)), n as (select *, c * volume as notional from f) select symbol, open_ms, round(notional * rate - cum, 4) as maintenance, rate from n join b on notional <= cap and (notional > floor or (floor = 0 and notional >= 0))")
def bracket_margin(spark, sf_dir):
    table = spark.createDataFrame(_BRACKETS, "floor long, cap long, rate double, cum long")
    rows = _fills(spark, sf_dir).withColumn("notional", F.col("c") * F.col("volume"))
    inside = F.expr("notional <= cap and (notional > floor or (floor = 0 and notional >= 0))")
    met = rows.join(F.broadcast(table), inside)
    return met.select("symbol", "open_ms", rounded(costs.maintenance(F.col("notional"), F.col("rate"), F.col("cum")), "maintenance", 4), "rate")


@query("order_grid", "with " + TRADES + " select id, concat_ws(',', case when price < 500 then 'BELOW_MINIMUM' end, case when price > 20000 then 'ABOVE_MAXIMUM' end, case when (price - 500) % 25 <> 0 then 'OFF_GRID' end) as reasons, cast(500 + floor((price - 500) / 25.0::double) * 25 as bigint) as suggested from trades")
def order_grid(spark, sf_dir):
    p, least, step = F.col("price"), F.lit(500), F.lit(25)
    return trades(spark, sf_dir).select("id", F.array_join(costs.grid_reasons(p, least, F.lit(20_000), step), ",").alias("reasons"), costs.suggested(p, least, step).cast("long").alias("suggested"))


@query("net_at_multiplier", "with o as (select l_orderkey, l_linenumber, cast(round(l_extendedprice * (l_discount - l_tax) * 100) as bigint) as net, cast(round(l_extendedprice * l_tax * 100) as bigint) as cost from lineitem) select l_orderkey, l_linenumber, net, round(greatest(-100000.0::double, net + (1 - 2.0::double) * cost), 4) as net2 from o")
def net_at_multiplier(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    net = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
    cost = F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long")
    rows = l.select("l_orderkey", "l_linenumber", net.alias("net"), cost.alias("cost"))
    return rows.select("l_orderkey", "l_linenumber", "net", rounded(costs.net_at(F.col("net"), F.col("cost"), F.lit(100_000.0), 2.0), "net2", 4))


@query("ols_gram", "select cast(count(*) as double) as n, round(sum(l_quantity), 2) as sx, round(sum(l_quantity * l_quantity), 2) as sxx, round(sum(l_quantity * l_extendedprice), 2) as sxy, round(regr_slope(l_extendedprice, l_quantity), 6) as slope from lineitem")
def ols_gram(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    g = stats.gram(rows, "l_extendedprice", ["l_quantity"])
    slope = (F.col("0_0") * F.col("1_2") - F.col("0_1") * F.col("0_2")) / (F.col("0_0") * F.col("1_1") - F.col("0_1") * F.col("0_1"))
    return g.select(F.col("0_0").alias("n"), rounded(F.col("0_1"), "sx", 2), rounded(F.col("1_1"), "sxx", 2), rounded(F.col("1_2"), "sxy", 2), rounded(slope, "slope"))


@query("ols_clustered")
def ols_clustered(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_suppkey")
    return stats.ols_clustered(rows, "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")


@query("regr_frame", FOUR_HOURLY + f", k as (select symbol, open_ms, close, row_number() over ({W}) as k from bars) select symbol, open_ms, case when count(*) over w = 10 then round(regr_slope(close, k) over w, 6) end as slope from k window w as ({W} rows between 9 preceding and current row)")
def regr_frame(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("open_ms")
    frame = w.rowsBetween(-9, 0)
    rows = four_hourly(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return rows.select("symbol", "open_ms", F.when(F.count("close").over(frame) == 10, F.round(F.regr_slope("close", "k").over(frame), 6)).alias("slope"))


_WIDE = f"with {TRADES}, d as (select ms // {DAY} as d, " + ", ".join(f"cast(arg_max(price, id) filter (where symbol = '{s}') as double) as {s}" for s in ("click", "error", "purchase", "signup", "view")) + " from trades group by 1)"


def _wide(spark, sf_dir):
    t = trades(spark, sf_dir)
    names = ["click", "error", "purchase", "signup", "view"]
    return t.groupBy(F.floor(F.col("ms") / DAY).alias("d")).agg(*[F.max_by(F.when(F.col("symbol") == s, F.col("price")), F.when(F.col("symbol") == s, F.col("id"))).cast("double").alias(s) for s in names]), names


@query("corr_matrix", _WIDE + " " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as rho from d" for i, a in enumerate(("click", "error", "purchase", "signup", "view")) for b in ("click", "error", "purchase", "signup", "view")[i + 1 :]))
def corr_matrix(spark, sf_dir):
    wide, names = _wide(spark, sf_dir)
    return stats.correlation_pairs(wide, names).select("a", "b", rounded(F.col("rho"), "rho"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """The interval of the daily mean, and deflated Sharpe, sign test and effective size beside it."""
    daily = outcomes(spark, sf_dir).groupBy("day").agg(F.sum("net").cast("double").alias("net")).orderBy("day").toPandas()["net"].to_numpy()
    means = stats.bootstrap_means(spark, daily, 200, 7, "ci|")
    held = F.array_sort(F.collect_list("mean"))
    sharpe = float(daily.mean() / daily.std(ddof=1)) if len(daily) > 1 else 0.0
    return means.agg(held.alias("m")).select(
        F.element_at("m", 5).alias("low"), F.element_at("m", 195).alias("high"), F.lit(float(daily.mean())).alias("mean"),
        F.lit(stats.deflated_sharpe(sharpe, 0.0, len(daily), 0.0, 3.0)).alias("deflated_sharpe"), F.lit(stats.sign_test(daily.tolist())).alias("sign_p"),
    )
