"""Queries over labels, states, statistics and models, with their SQL where it can be told."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import asof, bars, levels, rolling, sequential, stats, studies
from .market import rounded
from .report import outcomes
from .sequence import _wide
from .tables import DAY, FOUR_HOURLY, HOUR, TRADES, bars_sql, four_hourly, read, trades

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("ta_score", FOUR_HOURLY + f""", a as (select symbol, open_ms, close, volume, case when count(*) over x = 20 then avg(close) over x end as e20, case when count(*) over y = 50 then avg(close) over y end as e50, case when count(*) over x = 20 then avg(volume) over x end as v,
 100.0::double * sum(case when close > p then close - p else 0 end) over z / nullif(sum(abs(close - p)) over z, 0) as rsi, count(p) over z as n, cast(sign(close - open) as int) as pattern from (select *, lag(close) over ({W}) as p from bars) window x as ({W} rows 19 preceding), y as ({W} rows 49 preceding), z as ({W} rows 13 preceding)),
b as (select *, case when close > e20 and e20 > e50 then 40 when close < e20 and e20 < e50 then -40 else 0 end as t, case when rsi < 30 then -20 when rsi < 45 then -10 when rsi <= 55 then 0 when rsi <= 70 then 10 else 20 end as m from a)
select symbol, open_ms, cast(case when e20 is not null and e50 is not null and n = 14 and rsi is not null and v is not null then t + m + 20 * pattern + case when volume / v >= 1 then 20 * sign(t + m) else 0 end end as int) as score from b""")
def ta_score(spark, sf_dir):
    """The score over simple averages; ``sequential`` has the recursive ones."""
    c = F.col("close")
    rows = four_hourly(spark, sf_dir).withColumn("d", c - F.lag(c).over(rolling.by_symbol()))
    frame = rolling.last_rows(14)
    up, all_ = F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).over(frame), F.sum(F.abs("d")).over(frame)
    rsi = F.when((F.count("d").over(frame) == 14) & (all_ > 0), 100 * up / all_)
    rows = rows.select("symbol", "open_ms", "close", rolling.rolling_mean(c, 20).alias("e20"), rolling.rolling_mean(c, 50).alias("e50"), rsi.alias("rsi"), F.signum(c - F.col("open")).cast("int").alias("pattern"), (F.col("volume") / rolling.rolling_mean(F.col("volume"), 20)).alias("v"))
    return rows.select("symbol", "open_ms", studies.ta_score(c, F.col("e20"), F.col("e50"), F.col("rsi"), F.col("pattern"), F.col("v")).alias("score"))


_GRID = FOUR_HOURLY + f""", s as (select symbol, open_ms, first_id as id, close - close % 5 as price, case when count(r) over w = 20 then stddev_samp(r) over w end as sigma from (select *, ln(close / lag(close) over ({W})) as r from bars) window w as ({W} rows 19 preceding)),
g as (select s.*, d.side, k.k, r.rr, cast(ceil(k.k * s.sigma * s.price / 5) as bigint) as d from s cross join (select unnest([1, -1]) as side) d cross join (select unnest([1, 2]) as k) k cross join (select unnest([1.0, 1.5, 2.0, 3.0]) as rr) r)"""


@query("label_grid", _GRID + " select symbol, id, cast(side as int) as side, cast(k as int) as k, cast(rr as double) as rr, cast(price - side * d * 5 as bigint) as stop, cast(price + side * ceil(rr::double * d) * 5 as bigint) as target, case when d is null then 'V' when d < 4 then 'G' else 'T' end as status from g")
def label_grid(spark, sf_dir):
    return _labels(spark, sf_dir).select("symbol", "id", "side", "k", "rr", "stop", "target", "status")


def _labels(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).withColumn("r", rolling.log_return(F.col("close")))
    entries = rows.select("symbol", F.col("first_id").alias("id"), F.col("open_ms").alias("entry_ms"), (F.col("close") - F.col("close") % 5).alias("price"), rolling.rolling_std(F.col("r"), 20).alias("sigma"))
    return studies.label_grid(entries, F.col("sigma"), 5)


@query("label_outcomes")
def label_outcomes(spark, sf_dir):
    """Barrier outcomes of the whole grid, counted by geometry."""
    rows = _labels(spark, sf_dir).where("status = 'T'").withColumn("id", F.xxhash64("id", "side", "k", "rr"))
    out = asof.first_touch(rows, four_hourly(spark, sf_dir), 2 * DAY)
    return out.groupBy("side", "k", "rr").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(p) == o).alias(f"{p}_{o}") for p in ("pess", "opt") for o in "TSE"])


@query("liquidation_scan", f"with {TRADES}, p as (select symbol, id, ms as open_ms, case when id % 2 = 0 then 1 else -1 end as side, cast(round(price * case when id % 2 = 0 then 0.5::double else 1.5::double end) as bigint) as liq from trades) select p.symbol, p.id, min(t.ms) as liquidated_ms from p left join trades t on t.symbol = p.symbol and t.ms >= p.open_ms and t.ms < p.open_ms + {DAY} and ((p.side > 0 and t.price <= p.liq) or (p.side < 0 and t.price >= p.liq)) group by 1, 2")
def liquidation_scan(spark, sf_dir):
    t = trades(spark, sf_dir)
    long = F.col("id") % 2 == 0
    positions = t.select("symbol", "id", F.col("ms").alias("open_ms"), F.when(long, 1).otherwise(-1).alias("side"), F.round(F.col("price") * F.when(long, 0.5).otherwise(1.5)).cast("long").alias("liq"))
    found = studies.liquidation_scan(positions, t.select("symbol", "ms", F.col("price").alias("mark")), DAY)
    return found.groupBy("symbol", "id").agg(F.min("liquidated_ms").alias("liquidated_ms"))


@query("adverse_path", FOUR_HOURLY + f", d as (select symbol, open_ms, low, open_ms // {7 * DAY} as path, min(low) over (partition by symbol, open_ms // {7 * DAY} order by open_ms rows between unbounded preceding and 1 preceding) as worst from bars) select symbol, open_ms, low from d where worst is null or low < worst")
def adverse_path(spark, sf_dir):
    rows = four_hourly(spark, sf_dir).select("symbol", "open_ms", "low", F.concat_ws("|", "symbol", F.floor(F.col("open_ms") / (7 * DAY))).alias("path"), F.lit(1).alias("side"))
    return studies.adverse_path(rows, "path", "open_ms", "low", "side").select("symbol", "open_ms", "low")


_STATE = FOUR_HOURLY + f", s as (select symbol, open_ms, case when close > lag(close) over ({W}) then 'up' else 'down' end as state from bars)"


@query("state_spans", _STATE + f", n as (select *, coalesce(state <> lag(state) over ({W}) or open_ms - lag(open_ms) over ({W}) <> {4 * HOUR}, true) as fresh, max(open_ms) over (partition by symbol) as last from s), g as (select *, sum(case when fresh then 1 else 0 end) over ({W}) as g from n) select symbol, state, min(open_ms) as from_ms, max(open_ms) as to_ms, count(*) as rows, max(open_ms) = max(last) as censored from g group by symbol, state, g")
def state_spans(spark, sf_dir):
    return studies.state_spans(_states(spark, sf_dir), ["symbol"], "open_ms", "state", 4 * HOUR)


def _states(spark, sf_dir):
    c = F.col("close")
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", F.when(c > F.lag(c).over(rolling.by_symbol()), "up").otherwise("down").alias("state"))


@query("transition_counts", _STATE + f", p as (select lag(state) over ({W}) as a, state as b from s) select a as from_state, b as to_state, count(*) as n from p where a is not null and a <> b group by 1, 2")
def transition_counts(spark, sf_dir):
    return studies.transition_counts(_states(spark, sf_dir), ["symbol"], "open_ms", "state")


@query("study_dates", "with d as (select distinct cast(o_orderdate as date) as d from orders where o_orderstatus <> 'P'), r as (select d, row_number() over (partition by year(d), month(d) order by (isodow(d) + 4) % 7, d) as k from d where isodow(d) <= 5) select d from r where k = 1")
def study_dates(spark, sf_dir):
    """One date per month: the first Wednesday that has data, else the next weekday in turn."""
    days = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderdate").cast("date").alias("d")).distinct().where(F.weekday("d") < 5)
    return studies.first_eligible(days.withColumn("y", F.year("d")).withColumn("m", F.month("d")), ["y", "m"], (F.weekday("d") + 5) % 7, "d").select("d")


@query("sweeps", FOUR_HOURLY + f""", a as (select symbol, open_ms, high, low, close, max(high) over w as t, min(low) over w as b, avg(high - low) over w as a, count(*) over w as n from bars window w as ({W} rows between 20 preceding and 1 preceding)),
u as (select *, high > t + 0.1::double * a and close < t as up, low < b - 0.1::double * a and close > b as down from a) select symbol, open_ms, cast(case when n = 20 then case when up and not down then -1 when down and not up then 1 else 0 end end as int) as sweep from u""")
def sweeps(spark, sf_dir):
    return studies.sweeps(four_hourly(spark, sf_dir), 20, 0.1).select("symbol", "open_ms", "sweep")


@query("event_overlaps")
def event_overlaps(spark, sf_dir):
    rows = trades(spark, sf_dir).select("symbol", "id", "ms")

    def mark(g):
        return g.assign(overlap=studies.overlaps(g["ms"].tolist(), 6 * HOUR))

    return sequential.series(rows, "symbol", ["ms", "id"], mark, "symbol string, id long, ms long, overlap boolean")


@query("level_events")
def level_events(spark, sf_dir):
    """Touches of the nearest multiple of 5000 by four-hour bars, armed again beyond a tenth of it."""
    def mark(g):
        level = (g["close"] / 5000).round() * 5000
        touch = ((g["low"] <= level) & (g["high"] >= level)).tolist()
        far = ((g["close"] - level).abs() > 500).tolist()
        return g[["symbol", "open_ms"]].assign(level=level.astype("int64"), event=studies.level_events(touch, far))

    return sequential.series(four_hourly(spark, sf_dir), "symbol", ["open_ms"], mark, "symbol string, open_ms long, level long, event boolean")


@query("liquidity_pools")
def liquidity_pools(spark, sf_dir):
    b = four_hourly(spark, sf_dir)
    highs = levels.swings(b, 2, 240).where("kind = 'high'").select("symbol", F.col("valid_from").alias("at"), F.col("open_ms").alias("t"), F.col("level").cast("double").alias("v"), F.lit(0).alias("close"))
    closes = b.select("symbol", (F.col("open_ms") + 4 * HOUR).alias("at"), F.col("open_ms").alias("t"), F.col("close").cast("double").alias("v"), F.lit(1).alias("close"))

    def pools(g):
        swings = [tuple(r) for r in g[g["close"] == 0][["at", "t", "v"]].itertuples(index=False)]
        lines = [tuple(r) for r in g[g["close"] == 1][["at", "v"]].itertuples(index=False)]
        out = studies.liquidity_pools(swings, lines, 1000.0)
        frame = pd.DataFrame(out, columns=["level", "members", "known_ms", "broken_ms"], dtype=object)
        return frame.assign(symbol=g["symbol"].iloc[0])

    return sequential.series(highs.unionByName(closes), "symbol", ["at", "close"], pools, "level double, members long, known_ms long, broken_ms long, symbol string")


@query("causal_frontier", f"with c as (select l_orderkey, l_linenumber as id, epoch_us(l_shipdate) // 1000 as earliest, epoch_us(l_shipdate) // 1000 + cast(l_quantity as bigint) * {DAY // 10} as latest, l_suppkey % 3 as resource, l_returnflag as kind, l_tax < 0.08::double as available from lineitem), m as (select *, min(latest) over (partition by l_orderkey) as least from c), u as (select l_orderkey, resource, count(*) as n, count(*) filter (where kind <> 'N') as others, bool_and(available) as available from m where earliest <= least group by 1, 2), s as (select l_orderkey, bool_and(available) as available, bool_or(n > 1 and others > 0) as contested from u group by 1), i as (select l_orderkey, string_agg(cast(id as varchar), ',' order by id) as ids from m where earliest <= least group by 1) select s.l_orderkey, case when not available then 'UNAVAILABLE' when contested then 'AMBIGUOUS' else 'SELECTED' end as status, ids from s join i on i.l_orderkey = s.l_orderkey")
def causal_frontier(spark, sf_dir):
    at = calendar.epoch_ms(F.col("l_shipdate"))
    kind = F.when(F.col("l_returnflag") == "N", "funding").otherwise("fill")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), at.alias("earliest"), (at + F.col("l_quantity").cast("long") * (DAY // 10)).alias("latest"), (F.col("l_suppkey") % 3).alias("resource"), kind.alias("kind"), (F.col("l_tax") < 0.08).alias("available"))
    return studies.causal_frontier(rows, "l_orderkey").select("l_orderkey", "status", F.array_join("ids", ",").alias("ids"))


def _returns(spark, sf_dir):
    wide, names = _wide(spark, sf_dir)
    frame = wide.orderBy("d").toPandas()  # a row per calendar day
    return frame[names].pct_change().dropna().to_numpy(), names


@query("pca_common_factor")
def pca_common_factor(spark, sf_dir):
    returns, names = _returns(spark, sf_dir)
    share, loadings = stats.common_factor(returns)
    return spark.createDataFrame([(n, float(v), share) for n, v in zip(names, loadings, strict=True)], "symbol string, loading double, share double")


@query("correlation_clusters")
def correlation_clusters(spark, sf_dir):
    returns, names = _returns(spark, sf_dir)
    found = stats.clusters(np.corrcoef(returns.T), 0.9)
    return spark.createDataFrame([(names[k], i) for i, g in enumerate(found) for k in g], "symbol string, cluster int")


#: The regimes' model is fitted before this time and filtered from then on.
HMM_FROM = 1_705_276_800_000  # 2024-01-15


@query("hmm_regimes")
def hmm_regimes(spark, sf_dir):
    """The likeliest regime given the rows so far, by mean return, under a model of earlier days; null in the days it was fitted on."""

    def filtered(g):
        r = np.log(g["close"]).diff().fillna(0.0)
        x, early = np.column_stack((r, r.abs())), (g["open_ms"] < HMM_FROM).to_numpy()
        state = pd.array([pd.NA] * len(g), dtype="Int32")
        if early.sum() >= 30 and not early.all():
            move, mean, var, prob = stats.hmm_fit(x[early])
            rank = np.argsort(np.argsort(mean[:, 0]))
            state[~early] = rank[stats.hmm_filter(x[~early], move, mean, var, prob[-1]).argmax(1)].astype("int32")
        return g[["symbol", "open_ms"]].assign(state=state)

    return sequential.series(four_hourly(spark, sf_dir), "symbol", ["open_ms"], filtered, "symbol string, open_ms long, state int")


def _daily_matrix(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("day").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("net").cast("double")).na.fill(0.0).orderBy("day").toPandas()
    return rows[["A", "N", "R"]].to_numpy()


@query("spa_test")
def spa_test(spark, sf_dir):
    statistic, p = stats.spa(_daily_matrix(spark, sf_dir), 200, 7)
    return spark.createDataFrame([(float(statistic), p)], "statistic double, p double")


@query("stepm")
def stepm(spark, sf_dir):
    rejected = stats.stepm(_daily_matrix(spark, sf_dir), 0.05, 200, 7)
    return spark.createDataFrame([(n, k in rejected) for k, n in enumerate("ANR")], "strategy string, rejected boolean")


@query("newey_west_alpha")
def newey_west_alpha(spark, sf_dir):
    m = _daily_matrix(spark, sf_dir)
    alpha, se = stats.newey_west(m[:, 0], m[:, 1], 5)
    return spark.createDataFrame([(alpha, se)], "alpha double, se double")


@query("power_gate")
def power_gate(spark, sf_dir):
    m = _daily_matrix(spark, sf_dir)
    rows = [(n, stats.minimum_effect(float(m[:, k].std(ddof=1)), len(m), 10.0), stats.power_of(float(m[:, k].mean()), float(m[:, k].std(ddof=1)), len(m))) for k, n in enumerate("ANR")]
    return spark.createDataFrame(rows, "strategy string, minimum_effect double, power double")
