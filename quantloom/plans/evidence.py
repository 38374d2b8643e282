"""Queries over checks, identities, signals, evidence joins and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar, costs, exact
from ..operators import evidence, validation
from .market import rounded
from .proofs import BARS, ema, walk, wilder
from .tables import DAY, FOUR_HOURLY, HOUR, HOURLY, TRADES, four_hourly, hourly, read, trades

QUERIES, SQL = {}, {}
W = "partition by symbol order by open_ms"
CUT = 1_705_276_800_000  # 2024-01-15
MINUTE = calendar.MINUTE


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _along():
    return Window.partitionBy("symbol").orderBy("open_ms")


# -- identities and texts


@query("rational_text", "select p_partkey, case when d = 1 then cast(n as varchar) else n || '/' || d end as ratio from (select p_partkey, cast(p_size as bigint) * 6 // gcd(cast(p_size as bigint) * 6, 2 + p_partkey % 9) as n, (2 + p_partkey % 9) // gcd(cast(p_size as bigint) * 6, 2 + p_partkey % 9) as d from part)")
def rational_text(spark, sf_dir):
    """Exact quotients in lowest terms; whole ones without a denominator."""
    text = exact.ratio_text(F.col("p_size").cast("long") * 6, 2 + F.col("p_partkey") % 9)
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(text, "/1$", "").alias("ratio"))


@query("signal_ids", f"with {TRADES}, s as (select id, sha256(concat_ws('|', 'ma', 'v1', symbol, ms, case when maker then -1 else 1 end)) as signal_id from trades) select id, signal_id, sha256(concat_ws('|', signal_id, '3/2', '2', 'p')) as setup_id from s")
def signal_ids(spark, sf_dir):
    side = F.when(F.col("maker"), -1).otherwise(1)
    rows = trades(spark, sf_dir).select("id", exact.signal_id(F.lit("ma"), F.lit("v1"), F.col("symbol"), F.col("ms"), side).alias("signal_id"))
    return rows.withColumn("setup_id", exact.signal_id(F.col("signal_id"), F.lit("3/2"), F.lit("2"), F.lit("p")))


@query("placebo_draws", f"with {TRADES}, b as (select id, sha256('7|forward-placebo:' || symbol || ':ma|' || cast(ms // {MINUTE} * 2 // 4 as varchar)) as h, ms // {MINUTE} * 2 % 4 as o from trades) select id, cast(cast('0x' || substr(h, 1 + 16 * o, 16) as ubigint) as varchar) as first, cast(cast('0x' || substr(h, 17 + 16 * o, 16) as ubigint) as varchar) as second from b")
def placebo_draws(spark, sf_dir):
    one, two = evidence.placebo_words(7, F.col("symbol"), "ma", F.col("ms"))
    return trades(spark, sf_dir).select("id", one.cast("string").alias("first"), two.cast("string").alias("second"))


@query("csv_cells", """with t as (select p_partkey, case p_partkey % 4 when 0 then '=' when 1 then '-' when 2 then 'a"b,' else '' end || p_name as c from part), n as (select p_partkey, case when regexp_matches(c, '^[=+\\-@\\t\\r]') then '''' || c else c end as c from t) select p_partkey, case when regexp_matches(c, '[",\\n\\r]') then '"' || replace(c, '"', '""') || '"' else c end as cell from n""")
def csv_cells(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, 'a"b,').otherwise(""), "p_name")
    return read(spark, sf_dir, "part").select("p_partkey", evidence.csv_cell(text).alias("cell"))


@query("hashed_minutes", f"with {TRADES} select symbol, ms - ms % {MINUTE} as open_ms, md5(concat_ws('|', symbol, ms - ms % {MINUTE}, arg_min(price, id), max(price), min(price), arg_max(price, id), sum(qty))) as row_hash from trades where ms < {CUT} group by symbol, ms - ms % {MINUTE}")
def hashed_minutes(spark, sf_dir):
    """Minutes before a time with a hash of their contents, as a reader compares them."""
    b = trades(spark, sf_dir).where(F.col("ms") < CUT).groupBy("symbol", calendar.bucket(F.col("ms"), 1).alias("open_ms")).agg(F.min_by("price", "id").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "id").alias("c"), F.sum("qty").alias("v"))
    return b.select("symbol", "open_ms", exact.row_hash(*[F.col(c) for c in ("symbol", "open_ms", "o", "h", "l", "c", "v")]).alias("row_hash"))


@query("collector_scaled", "select event_id, cast(cast(round_even(cast(cast(value as varchar) as decimal(38,12)), 8) * 100000000 as hugeint) as varchar) as scaled from events")
def collector_scaled(spark, sf_dir):
    """Doubles as integers times 10**8, half to even."""
    return read(spark, sf_dir, "events").select("event_id", exact.to_scaled(F.col("value")).cast("string").alias("scaled"))


@query("bucket_ends", f"with {TRADES} select id, cast(ceil(ms / 5000.0::double) * 5000 as bigint) as ends_ms from trades")
def bucket_ends(spark, sf_dir):
    """Right-closed five-second buckets: a trade on a boundary belongs to the bucket that ends there."""
    return trades(spark, sf_dir).select("id", calendar.right_closed(F.col("ms")).cast("long").alias("ends_ms"))


# fixed values: the days on which the reward halved
_HALVINGS = ("2012-11-28", "2016-07-09", "2020-05-11", "2024-04-20")


@query("halving_months", "with d as (select distinct cast(o_orderdate as date) as day from orders), h as (select day, max(cast(h as date)) as h from d join (values " + ", ".join(f"('{h}')" for h in _HALVINGS) + ") v(h) on cast(h as date) <= day group by day) select d.day, case when h is not null then (year(d.day) - year(h)) * 12 + month(d.day) - month(h) - case when day(d.day) < day(h) then 1 else 0 end end as months from d left join h on h.day = d.day")
def halving_months(spark, sf_dir):
    day = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return day.select("day", calendar.halving_months(F.col("day")).cast("long").alias("months"))


@query("supremum_cdf", "with x as (select i / 10.0::double as x from range(0, 41) t(i)) select x, round(case when x <= 0 then 0 else least(1, greatest(0, 4 / pi() * list_sum([case when n % 2 = 0 then 1 else -1 end * exp(-power(2 * n + 1, 2) * pi() * pi() / (8 * x * x)) / (2 * n + 1) for n in range(60)]))) end, 9) as p from x")
def supremum_cdf(spark, sf_dir):
    rows = spark.range(41).select((F.col("id") / 10.0).alias("x"))
    return rows.select("x", rounded(evidence.supremum_cdf(F.col("x")), "p", 9))


# -- checks


@query("candle_sanity", HOURLY + f", d as (select symbol, open_ms + case when first_id % 7 = 0 then 1 else 0 end as open_ms, case when first_id % 5 = 0 then high + 1 else open end as open, high, low, case when first_id % 11 = 0 then null else close end as close, case when first_id % 13 = 0 then -1 else volume end as volume from bars) select symbol, open_ms, concat_ws(',', case when open_ms % {HOUR} <> 0 then 'INTERVAL' end, case when close is null or least(open, high, low, close) <= 0 then 'PRICE' end, case when volume < 0 then 'VOLUME' end, case when close is null or not (open between low and high and close between low and high) then 'RANGE' end) as reasons from d")
def candle_sanity(spark, sf_dir):
    k = F.col("first_id")
    spoilt = {"open_ms": F.col("open_ms") + F.when(k % 7 == 0, 1).otherwise(0), "open": F.when(k % 5 == 0, F.col("high") + 1).otherwise(F.col("open")), "close": F.when(k % 11 != 0, F.col("close")), "volume": F.when(k % 13 == 0, -1).otherwise(F.col("volume"))}
    d = hourly(spark, sf_dir).select("symbol", "high", "low", *[v.alias(n) for n, v in spoilt.items()])
    return d.select("symbol", "open_ms", evidence.candle_reasons(*[F.col(c) for c in ("open_ms", "open", "high", "low", "close", "volume")], 60).alias("reasons"))


@query("worst_case_ends", f"select o_orderkey, epoch_us(o_orderdate) // 1000 + (o_orderkey % 3 + 1) * 240 * 4 * {MINUTE} as end_ms from orders")
def worst_case_ends(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", evidence.worst_case_end(calendar.epoch_ms(F.col("o_orderdate")), (F.col("o_orderkey") % 3 + 1) * 240).alias("end_ms"))


@query("comparison_text", "with c as (select s_suppkey as k, count(*) as n, count(distinct cast(l_shipdate as date)) as days, round(avg(l_discount - l_tax) / nullif(stddev_samp(l_discount - l_tax), 0) * sqrt(count(*)), 9) as z from supplier left join lineitem on l_suppkey = s_suppkey and l_linenumber < s_suppkey % 5 group by 1), j as (select a.k, a.n, a.days, a.z, b.n as control_n, b.days as control_days from c a left join c b on b.k = a.k + 1 and b.k % 3 <> 0) select k, case when n < 30 or days < 10 or control_n < 30 or control_days < 10 then 'too_few' when control_n is null then 'no_baseline' when z is null then 'no_spread' when abs(z) < 2 then 'no_difference' when z < 0 then 'worse' else 'better' end as verdict from j")
def comparison_text(spark, sf_dir):
    l, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier").select("s_suppkey")
    x, spread = F.col("l_discount") - F.col("l_tax"), F.stddev_samp(F.col("l_discount") - F.col("l_tax"))
    rows = s.join(l, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("l_linenumber") < F.col("s_suppkey") % 5), "left")
    c = rows.groupBy(F.col("s_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("l_shipdate")).alias("days"), F.round(F.avg(x) / F.when(spread != 0, spread) * F.sqrt(F.count(F.lit(1))), 9).alias("z"))
    control = c.where(F.col("k") % 3 != 0).select((F.col("k") - 1).alias("k"), F.col("n").alias("control_n"), F.col("days").alias("control_days"))
    return c.join(control, "k", "left").select("k", evidence.comparison(*[F.col(n) for n in ("n", "days", "control_n", "control_days", "z")], 2.0, 30, 10).alias("verdict"))


@query("verdict_order", "with o as (select l_suppkey as k, count(*) as n, sum(l_discount - l_tax) as one, sum(l_discount - 2 * l_tax) as two, sum(l_discount - l_tax / 2) as opt, count(*) filter (where l_returnflag = 'A') as amb, count(*) filter (where l_linenumber = 7) as x, avg(l_discount - l_tax) - stddev_samp(l_discount - l_tax) / sqrt(count(*)) as low from lineitem group by 1) select k, case when not (n >= 20) then 'NOT_ENOUGH_EVIDENCE' when (round(one, 6) > 0 and round(two, 6) <= 0) or round(one, 6) * round(opt, 6) < 0 or 10 * amb > 4 * n or x > 0.05 * n then 'FRAGILE' when k % 2 = 0 and round(low, 9) > 0 and round(two, 6) > 0 then 'PASS' else 'FAIL' end as verdict from o")
def verdict_order(spark, sf_dir):
    a, t = F.col("l_discount"), F.col("l_tax")
    n = F.count(F.lit(1))
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        n.alias("n"), F.round(F.sum(a - t), 6).alias("one"), F.round(F.sum(a - 2 * t), 6).alias("two"), F.round(F.sum(a - t / 2), 6).alias("opt"),
        (F.count_if(F.col("l_returnflag") == "A") / 4).alias("amb"), F.count_if(F.col("l_linenumber") == 7).alias("x"), F.round(F.avg(a - t) - F.stddev_samp(a - t) / F.sqrt(n), 9).alias("low"),
    )
    c = F.col
    return o.select("k", evidence.experiment_verdict(c("n") >= 20, c("one"), c("two"), c("opt"), c("amb"), c("x"), c("n"), c("k") % 2 == 0, c("low")).alias("verdict"))


_FEED = f"f as (select symbol, max(ms - ms % {MINUTE}) as newest from trades where ms < 1705600800000 group by symbol), p as (select symbol, newest, newest + (length(symbol) - 3) * 3 * {MINUTE} as now from f)"


@query("feed_health", f"with {TRADES}, {_FEED}, t as (select *, timezone('America/New_York', make_timestamptz(now * 1000)) as l from p) select symbol, case when isodow(l) = 6 or (isodow(l) = 5 and hour(l) >= 17) or (isodow(l) = 7 and hour(l) < 17) then 'MARKET_CLOSED' when now - newest - {MINUTE} > {10 * MINUTE} then 'STALE' when now - newest - {MINUTE} > {3 * MINUTE} then 'RECOVERING' else 'LIVE' end as status from t")
def feed_health(spark, sf_dir):
    f = trades(spark, sf_dir).where("ms < 1705600800000").groupBy("symbol").agg(F.max(calendar.bucket(F.col("ms"), 1)).alias("newest"))
    now = F.col("newest") + (F.length("symbol") - 3) * 3 * MINUTE
    return f.select("symbol", evidence.feed_health(now, F.col("newest"), validation.fx_open(now), 3 * MINUTE, 10 * MINUTE).alias("status"))


@query("calendar_coverage", f"with o as (select c_custkey, max(epoch_us(o_orderdate) // 1000) as ok from customer left join orders on o_custkey = c_custkey group by 1), n as (select max(ok) as now from o) select c_custkey, case when ok is null then 'calendar_never_fetched' when now - ok > {200 * DAY} then 'calendar_stale' when c_custkey % 3 = 0 or ok + (c_custkey % 9) * {30 * DAY} < now then 'calendar_horizon_short' end as reason from o, n")
def calendar_coverage(spark, sf_dir):
    o = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max(calendar.epoch_ms(F.col("o_orderdate"))).alias("ok"))
    o = o.join(F.broadcast(o.agg(F.max("ok").alias("now"))))
    k = F.col("c_custkey")
    covered = F.when(k % 3 != 0, F.col("ok") + (k % 9) * (30 * DAY))
    return o.select("c_custkey", evidence.coverage_reason(F.col("ok"), covered, F.col("now"), F.col("now"), 200 * DAY).alias("reason"))


# -- joins of evidence


@query("regime_by_day", FOUR_HOURLY + f", d as (select ms // {DAY} as d, sum(price * qty) as v from trades group by 1), r as (select d + 1 as d, case when v > avg(v) over (order by d rows between 5 preceding and 1 preceding) then 'busy' else 'calm' end as regime from d) select symbol, open_ms, regime from bars left join r on r.d = open_ms // {DAY}")
def regime_by_day(spark, sf_dir):
    """Each candle with the regime of the day before its own; days are few, so their table is broadcast."""
    d = trades(spark, sf_dir).groupBy(F.floor(F.col("ms") / DAY).alias("d")).agg(F.sum(F.col("price") * F.col("qty")).alias("v"))
    w = Window.orderBy("d").rowsBetween(-5, -1)
    r = d.select((F.col("d") + 1).alias("d"), F.when(F.col("v") > F.avg("v").over(w), "busy").otherwise("calm").alias("regime"))
    return four_hourly(spark, sf_dir).withColumn("d", F.floor(F.col("open_ms") / DAY)).join(F.broadcast(r), "d", "left").select("symbol", "open_ms", "regime")


@query("mark_divergence", f"with {TRADES}, m as (select symbol, ms // {HOUR} as h, arg_max(price, id) filter (where maker) as mark, arg_max(price, id) filter (where not maker) as trade from trades group by 1, 2) select symbol, h, round(1e4::double * (trade - mark) / mark, 6) as bp from m where mark is not null and trade is not null")
def mark_divergence(spark, sf_dir):
    """Hours in which both price kinds exist: their distance in basis points."""
    t = trades(spark, sf_dir).withColumn("h", F.floor(F.col("ms") / HOUR))
    side = lambda maker, name: t.where(F.col("maker") == maker).groupBy("symbol", "h").agg(F.max_by("price", "id").alias(name))
    return side(True, "mark").join(side(False, "trade"), ["symbol", "h"]).select("symbol", "h", rounded(1e4 * (F.col("trade") - F.col("mark")) / F.col("mark"), "bp"))


@query("funding_parity", f"with {TRADES}, e as (select symbol, ms // {8 * HOUR} as k, arg_min(price, id) filter (where maker) as a, arg_min(price - price % 2, id) filter (where not maker) as b from trades group by 1, 2) select symbol, count(*) filter (where a is not null and b is not null) as compared, count(*) filter (where a = b) as equal, count(*) filter (where a <> b) as differing, count(*) filter (where a is null) as second_only, count(*) filter (where b is null) as first_only from e group by 1")
def funding_parity(spark, sf_dir):
    """Two records of the same settlements: how many agree, differ, or are in one only."""
    t = trades(spark, sf_dir).withColumn("k", F.floor(F.col("ms") / (8 * HOUR)))
    a = t.where("maker").groupBy("symbol", "k").agg(F.min_by("price", "id").alias("a"))
    b = t.where("not maker").groupBy("symbol", "k").agg(F.min_by(F.col("price") - F.col("price") % 2, "id").alias("b"))
    j = a.join(b, ["symbol", "k"], "full_outer")
    has = F.col("a").isNotNull() & F.col("b").isNotNull()
    counts = {"compared": has, "equal": F.col("a") == F.col("b"), "differing": F.col("a") != F.col("b"), "second_only": F.col("a").isNull(), "first_only": F.col("b").isNull()}
    return j.groupBy("symbol").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query("replication", "with c as (select l_suppkey % 7 as cell, l_linestatus as part, regr_slope(l_extendedprice * l_discount, l_quantity) as beta from lineitem where l_quantity > 0 group by 1, 2) select a.cell, sign(a.beta) = sign(b.beta) as same_sign from c a left join c b on b.cell = a.cell and b.part = 'F' where a.part = 'O'")
def replication(spark, sf_dir):
    """Whether an effect in the later part of the data has the sign that it had in the earlier, cell by cell."""
    c = read(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy((F.col("l_suppkey") % 7).alias("cell"), F.col("l_linestatus").alias("part")).agg(F.regr_slope(F.col("l_extendedprice") * F.col("l_discount"), "l_quantity").alias("beta"))
    ref = c.where("part = 'F'").select("cell", F.col("beta").alias("reference"))
    return c.where("part = 'O'").join(ref, "cell", "left").select("cell", (F.signum("beta") == F.signum("reference")).alias("same_sign"))


@query("outcome_transitions", "with p as (select o_orderkey as id, case o_orderstatus when 'O' then 'pending' when 'P' then 'open' else 'closed' end as state from orders), s as (select l_orderkey as id, arg_min(l_returnflag, (l_linenumber, l_returnflag)) as f from lineitem group by 1) select p.id, state, case f when 'R' then 'closed' when 'A' then 'open' else 'pending' end as offered, case when s.id is null then 'NOT_SUPPLIED' when case f when 'R' then 2 when 'A' then 1 else 0 end > case state when 'pending' then 0 when 'open' then 1 else 2 end then 'APPLIED' when case f when 'R' then 2 when 'A' then 1 else 0 end = case state when 'pending' then 0 when 'open' then 1 else 2 end then 'UNCHANGED' else 'REFUSED' end as result from p left join s on s.id = p.id")
def outcome_transitions(spark, sf_dir):
    """Outcomes only move on: pending, open, closed; an offer that goes back is refused."""
    status, flag = F.col("o_orderstatus"), F.col("f")
    state = F.when(status == "O", "pending").when(status == "P", "open").otherwise("closed")
    offered = F.when(flag == "R", "closed").when(flag == "A", "open").otherwise("pending")
    rank = lambda c: F.when(c == "pending", 0).when(c == "open", 1).otherwise(2)
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("f"), F.lit(True).alias("there"))
    j = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state")).join(s, "id", "left").withColumn("offered", offered)
    step = rank(F.col("offered")) - rank(F.col("state"))
    return j.select("id", "state", "offered", F.when(F.col("there").isNull(), "NOT_SUPPLIED").when(step > 0, "APPLIED").when(step == 0, "UNCHANGED").otherwise("REFUSED").alias("result"))


@query("stage_commits", "with o as (select o_custkey as account, o_orderkey as run, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as held, case when o_orderkey % 5 = 0 then o_orderkey - 1 else lag(o_orderkey) over (partition by o_custkey order by o_orderkey) end as expected from orders) select account, run, case when held is not distinct from expected then 'COMMITTED' else 'CONFLICT' end as status from o")
def stage_commits(spark, sf_dir):
    """A run is committed if the state that it expects is the one held."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    held, run = F.lag("o_orderkey").over(w), F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), run.alias("run"), held.alias("held"), F.when(run % 5 == 0, run - 1).otherwise(held).alias("expected"))
    return rows.select("account", "run", F.when(F.col("held").eqNullSafe(F.col("expected")), "COMMITTED").otherwise("CONFLICT").alias("status"))


@query("calendar_versions", f"with {TRADES}, k as (select symbol, ms // {DAY} as d, id, ms from trades where ms <= {CUT}) select id, symbol || ':' || d || ':' || row_number() over (partition by symbol, d order by ms, id) as version_id, lead(id) over (partition by symbol, d order by ms, id) is null as latest from k")
def calendar_versions(spark, sf_dir):
    """Events known by a time under an id of their day and version."""
    rows = trades(spark, sf_dir).select("symbol", F.floor(F.col("ms") / DAY).alias("d"), "id", "ms", F.struct("ms", "id").alias("known")).where(F.col("ms") <= CUT)
    w = Window.partitionBy("symbol", "d").orderBy("ms", "id")
    return rows.select("id", F.concat_ws(":", "symbol", "d", F.row_number().over(w)).alias("version_id"), F.lead("id").over(w).isNull().alias("latest"))


# -- bars, reads, order


@query("quote_minutes", f"with {TRADES} select symbol, ms - ms % {MINUTE} as open_ms, arg_min(price, (ms, id)) as open, max(price) as high, min(price) as low, arg_max(price, (ms, id)) as close, arg_max(qty % 7, (ms, id)) as spread_points, count(*) as tick_volume from trades group by 1, 2")
def quote_minutes(spark, sf_dir):
    """Ticks to minute bars of bids, with the last tick's spread in points and the number of ticks."""
    at = F.struct("ms", "id")
    return trades(spark, sf_dir).groupBy("symbol", calendar.bucket(F.col("ms"), 1).alias("open_ms")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.max_by(F.col("qty") % 7, at).alias("spread_points"), F.count(F.lit(1)).alias("tick_volume")
    )


@query("replay_order", f"with {TRADES} select id, row_number() over (partition by ms // {DAY} order by ms, symbol, length(cast(id as varchar)), cast(id as varchar)) as place from trades")
def replay_order(spark, sf_dir):
    """The canonical order of trades within a day: time, symbol, then the id as a number's text."""
    text = F.col("id").cast("string")
    w = Window.partitionBy(F.floor(F.col("ms") / DAY)).orderBy("ms", "symbol", F.length(text), text)
    return trades(spark, sf_dir).select("id", F.row_number().over(w).alias("place"))


@query("contiguous_parts", HOURLY + f", p as (select symbol, open_ms // {7 * DAY} as week, min(open_ms) as first, max(open_ms) as last, count(*) as n from bars group by 1, 2) select symbol, week, n, (last - first) // {HOUR} + 1 = n as whole, lag(last) over (partition by symbol order by week) + {HOUR} = first as joins from p")
def contiguous_parts(spark, sf_dir):
    """Parts of a series: whether each is without gaps and begins where the one before ends."""
    p = hourly(spark, sf_dir).groupBy("symbol", F.floor(F.col("open_ms") / (7 * DAY)).alias("week")).agg(F.min("open_ms").alias("first"), F.max("open_ms").alias("last"), F.count(F.lit(1)).alias("n"))
    before = F.lag("last").over(Window.partitionBy("symbol").orderBy("week"))
    return p.select("symbol", "week", "n", (F.floor((F.col("last") - F.col("first")) / HOUR) + 1 == F.col("n")).alias("whole"), (before + HOUR == F.col("first")).alias("joins"))


@query("storage_diagnostics", f"with {TRADES} select symbol, count(*) as rows, min(ms) as oldest, max(ms) as newest, count(distinct ms // {DAY}) as days from trades group by 1")
def storage_diagnostics(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ms").alias("oldest"), F.max("ms").alias("newest"), F.countDistinct(F.floor(F.col("ms") / DAY)).alias("days"))


@query("manifest_counts", "select l_linestatus as segment, l_returnflag as status, count(*) as rows, round(count(*) / sum(count(*)) over (partition by l_linestatus), 9) as share from lineitem group by 1, 2")
def manifest_counts(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("segment"), F.col("l_returnflag").alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("segment")), 9))


@query("grouped_medians", "select l_suppkey % 7 as mode, round(median(l_extendedprice), 6) as price, round(median(l_quantity), 6) as quantity, count(*) as n from lineitem group by 1")
def grouped_medians(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("mode")).agg(rounded(F.median("l_extendedprice"), "price"), rounded(F.median("l_quantity"), "quantity"), F.count(F.lit(1)).alias("n"))


@query("daily_bars_since", f"with {TRADES} select symbol, ms // {DAY} * {DAY} as open_ms, arg_min(price, id) as open, max(price) as high, min(price) as low, arg_max(price, id) as close, sum(qty)::bigint as volume from trades where ms // {DAY} * {DAY} >= {CUT} group by 1, 2")
def daily_bars_since(spark, sf_dir):
    day = calendar.day(F.col("ms"))
    return trades(spark, sf_dir).where(day >= CUT).groupBy("symbol", day.alias("open_ms")).agg(F.min_by("price", "id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "id").alias("close"), F.sum("qty").alias("volume"))


@query("open_minutes_ahead", f"""with {TRADES}, m as (select unnest(range((select min(ms) // {DAY} * {DAY} from trades), (select max(ms) // {DAY} * {DAY} from trades) + {3 * DAY}, {15 * MINUTE})) as ms),
o as (select ms, timezone('America/New_York', make_timestamptz(ms * 1000)) as l from m), c as (select ms, sum(case when isodow(l) = 6 or (isodow(l) = 5 and hour(l) >= 17) or (isodow(l) = 7 and hour(l) < 17) then 0 else 15 end) over (order by ms) as open from o)
select t.id, cast(b.open - a.open as bigint) as open_minutes from trades t join c a on a.ms = t.ms // {15 * MINUTE} * {15 * MINUTE} join c b on b.ms = t.ms // {15 * MINUTE} * {15 * MINUTE} + {2 * DAY}""")
def open_minutes_ahead(spark, sf_dir):
    """Open minutes of the two days after each trade's quarter hour, from prefix sums over the calendar."""
    t = trades(spark, sf_dir)
    step = 15 * MINUTE
    ends = t.agg(calendar.day(F.min("ms")).alias("a"), calendar.day(F.max("ms")).alias("b"))
    spine = ends.select(F.explode(F.sequence("a", F.col("b") + 3 * DAY, F.lit(step))).alias("ms"))
    total = F.sum(F.when(validation.fx_open(F.col("ms")), 15).otherwise(0)).over(Window.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))
    c = spine.select(F.col("ms").alias("q"), total.alias("open"))
    q = t.select("id", (F.col("ms") - F.col("ms") % step).alias("q"))
    later = c.select((F.col("q") - 2 * DAY).alias("q"), F.col("open").alias("then"))
    return q.join(c, "q").join(later, "q").select("id", (F.col("then") - F.col("open")).alias("open_minutes"))


@query("missing_open_hours", f"with {TRADES}, e as (select symbol, min(ms) // {HOUR} * {HOUR} as a, max(ms) as b from trades group by 1), s as (select symbol, unnest(range(a, b, {HOUR})) as h from e), o as (select *, timezone('America/New_York', make_timestamptz(h * 1000)) as l from s) select o.symbol, count(*) as missing from o where not (isodow(l) = 6 or (isodow(l) = 5 and hour(l) >= 17) or (isodow(l) = 7 and hour(l) < 17)) and not exists (select 1 from trades t where t.symbol = o.symbol and t.ms // {HOUR} * {HOUR} = o.h) group by 1")
def missing_open_hours(spark, sf_dir):
    """Open hours of each symbol's span in which it has no trade."""
    t = trades(spark, sf_dir).withColumn("h", F.col("ms") - F.col("ms") % HOUR)
    spine = t.groupBy("symbol").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("symbol", F.explode(F.sequence("a", "b", F.lit(HOUR))).alias("h"))
    return spine.where(validation.fx_open(F.col("h"))).join(t.select("symbol", "h").distinct(), ["symbol", "h"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))


# -- signals and features


_ZSQL = "z as (select symbol, open_ms, k, close, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) as z from n window w as (partition by symbol order by k rows between 19 preceding and current row))"


def _scored(spark, sf_dir):
    w = _along().rowsBetween(-19, 0)
    return four_hourly(spark, sf_dir).withColumn("z", (F.col("close") - F.avg("close").over(w)) / F.nullif(F.stddev_samp("close").over(w), F.lit(0.0)))


@query("macd_cross", BARS + f""", {ema('fast', 12)}, {ema('slow', 26)}, line as (select f.symbol, f.k, f.k - 53 as j, f.e - s.e as v from fast f join slow s on s.symbol = f.symbol and s.k = f.k where f.k >= 54),
seed as (select symbol, cast(floor(sum(v) / 9.0) as bigint) as e from line where j <= 9 group by symbol having count(*) = 9),
sig as (select symbol, 9::bigint as j, e from seed union all select x.symbol, x.j, r.e + cast(floor((x.v - r.e) * 2 / 10.0) as bigint) from sig r join line x on x.symbol = r.symbol and x.j = r.j + 1),
d as (select n.symbol, open_ms, n.k, line.v - case when sig.j >= 20 then sig.e end as d from n left join line on line.symbol = n.symbol and line.k = n.k left join sig on sig.symbol = line.symbol and sig.j = line.j)
select symbol, open_ms, case when lag(d) over w <= 0 and d > 0 then 1 when lag(d) over w >= 0 and d < 0 then -1 else 0 end as side from d window w as (partition by symbol order by k)""")
def macd_cross(spark, sf_dir):
    from .sequence import macd

    d = macd(spark, sf_dir).withColumn("d", F.col("line") - F.col("signal"))
    return d.select("symbol", "open_ms", evidence.zero_crossings(F.col("d"), F.lag("d").over(_along())).alias("side"))


@query("keltner_breakout", BARS + f""", {ema('mid', 20)}, m as (select symbol, k, k - 1 as j, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w))::bigint as v from n window w as (partition by symbol order by k)), tr as (select symbol, j, v from m where j > 0), {wilder('a', 'tr', 14)},
b as (select n.symbol, n.open_ms, n.k, n.close::bigint * 1048576 as c, case when n.k >= 42 then mid.e end + case when n.k > 56 then a.a end as up, case when n.k >= 42 then mid.e end - case when n.k > 56 then a.a end as down from n left join mid on mid.symbol = n.symbol and mid.k = n.k left join a on a.symbol = n.symbol and a.j = n.k - 1)
select symbol, open_ms, case when lag(c) over w <= lag(up) over w and c > up then 1 when lag(c) over w >= lag(down) over w and c < down then -1 else 0 end as side from b window w as (partition by symbol order by k)""")
def keltner_breakout(spark, sf_dir):
    """Closes that leave the band of one exact average true range around the exact average."""
    from .sequence import _nullable, _per_symbol, sequential

    def bands(g):
        return {"c": g["close"].astype("int64") * sequential.SCALE, "mid": _nullable(sequential.ema(g["close"].tolist(), 20)), "atr": _nullable(sequential.atr(g["high"].tolist(), g["low"].tolist(), g["close"].tolist()))}

    b = _per_symbol(spark, sf_dir, "c long, mid long, atr long", bands).withColumn("up", F.col("mid") + F.col("atr")).withColumn("down", F.col("mid") - F.col("atr"))
    before = {c: F.lag(c).over(_along()) for c in ("c", "up", "down")}
    side = F.when((before["c"] <= before["up"]) & (F.col("c") > F.col("up")), 1).when((before["c"] >= before["down"]) & (F.col("c") < F.col("down")), -1).otherwise(0)
    return b.select("symbol", "open_ms", side.alias("side"))


_FADES = f"r.armed or coalesce(abs(x.z) < 0.5, false)"
_FIRES = f"({_FADES}) and coalesce(abs(x.z) >= 1.5, false) and (r.last is null or x.open_ms - r.last >= {DAY})"


@query("fade_signals", f"""{BARS}, {_ZSQL}, f as (select symbol, open_ms, k, case when k >= 20 then z end as z from z),
{walk("true, null::bigint, 0", f"case when {_FIRES} then false else {_FADES} end, case when {_FIRES} then x.open_ms else r.last end, case when {_FIRES} then case when x.z > 0 then -1 else 1 end else 0 end", "symbol, k, armed, last, signal", "f")}
select n.symbol, open_ms, signal from n join r on r.symbol = n.symbol and r.k = n.k""")
def fade_signals(spark, sf_dir):
    """Against an extreme score, once until it has been small again, and not within a day of the one before."""
    import pandas as pd

    from .sequence import sequential

    def fade(g):
        z = (g["close"] - g["close"].rolling(20).mean()) / g["close"].rolling(20).std()
        return g[["symbol", "open_ms"]].assign(signal=pd.array(sequential.fades(z.tolist(), g["open_ms"].tolist(), 1.5, 0.5, DAY), dtype="int32"))

    return sequential.series(four_hourly(spark, sf_dir), "symbol", ["open_ms"], fade, "symbol string, open_ms long, signal int")


@query("flush_flags", BARS + ", " + _ZSQL + ", s as (select symbol, open_ms, k, z, ln(close) - ln(lag(close) over (partition by symbol order by k)) as ret from z), g as (select *, case when k > 21 then stddev_samp(ret) over (partition by symbol order by k rows between 20 preceding and 1 preceding) end as sigma from s) select symbol, open_ms, case when sigma is null or sigma = 0 or k < 20 or z is null then null when z <= -1 and ret <= -sigma then -1 when z <= -1 and ret >= sigma then 1 else 0 end as flush from g")
def flush_flags(spark, sf_dir):
    b = _scored(spark, sf_dir).withColumn("ret", F.ln("close") - F.ln(F.lag("close").over(_along()))).withColumn("k", F.row_number().over(_along()))
    sigma = F.when(F.col("k") > 21, F.stddev_samp("ret").over(_along().rowsBetween(-20, -1)))
    return b.select("symbol", "open_ms", evidence.flushes(F.col("ret"), sigma, F.when(F.col("k") >= 20, F.col("z")), 1.0, -1.0).alias("flush"))


@query("candle_geometry", FOUR_HOURLY + f" select symbol, open_ms, round(abs(close - open) / nullif(high - low, 0), 9) as body, round((high - greatest(open, close)) / nullif(high - low, 0), 9) as upper, round((least(open, close) - low) / nullif(high - low, 0), 9) as lower, round((close - low) / nullif(high - low, 0), 9) as location, round(lag(abs(close - open) / nullif(high - low, 0)) over ({W}), 9) as previous_body, arg_max(open_ms, volume * 100000000 + open_ms // {HOUR}) over ({W} rows between 5 preceding and current row) as climax_ms from bars")
def candle_geometry(spark, sf_dir):
    """Shape of each candle and of the one before, and which of the last six had the largest volume."""
    shape = evidence.geometry(*[F.col(c) for c in ("open", "high", "low", "close")])
    b = four_hourly(spark, sf_dir).select("symbol", "open_ms", "volume", *[v.alias(n) for n, v in shape.items()])
    climax = F.max_by("open_ms", F.col("volume") * 100_000_000 + F.floor(F.col("open_ms") / HOUR)).over(_along().rowsBetween(-5, 0))
    return b.select("symbol", "open_ms", *[rounded(F.col(n), n, 9) for n in shape], rounded(F.lag("body").over(_along()), "previous_body", 9), climax.alias("climax_ms"))


@query("period_opens", FOUR_HOURLY + f" select symbol, open_ms, first_value(open) over (partition by symbol, open_ms // {7 * DAY} order by open_ms) as week_open, sign(close - first_value(open) over (partition by symbol, open_ms // {7 * DAY} order by open_ms)) as side from bars")
def period_opens(spark, sf_dir):
    """The week's opening price as a level, known from its first candle, and the side that the close is on."""
    first = F.first("open").over(Window.partitionBy("symbol", F.floor(F.col("open_ms") / (7 * DAY))).orderBy("open_ms"))
    return four_hourly(spark, sf_dir).select("symbol", "open_ms", first.alias("week_open"), F.signum(F.col("close") - first).cast("int").alias("side"))


@query("follow_through", FOUR_HOURLY + f", a as (select symbol, open_ms, close, case when close > open then 1 when close < open then -1 else 0 end as d, count(*) over w as n, last_value(close) over w as c, max(high) over w as h, min(low) over w as l from bars window w as ({W} rows between 1 following and 6 following)) select symbol, open_ms, d as direction, case when n = 6 and d <> 0 then round(1e4::double * d * ln(c / close), 6) end as ret_bp, case when n = 6 and d <> 0 then round(1e4::double * case when d > 0 then ln(h / close) else ln(close / l) end, 6) end as mfe_bp, case when n = 6 and d <> 0 then round(1e4::double * case when d > 0 then ln(close / l) else ln(h / close) end, 6) end as mae_bp from a")
def follow_through(spark, sf_dir):
    b = four_hourly(spark, sf_dir).withColumn("direction", F.coalesce(F.signum(F.col("close") - F.col("open")).cast("int"), F.lit(0)))
    rows = evidence.follow_through(b, "symbol", "open_ms", F.col("direction"), 6)
    return rows.select("symbol", "open_ms", "direction", *[rounded(F.col(c), c) for c in ("ret_bp", "mfe_bp", "mae_bp")])


@query("horizon_returns", FOUR_HOURLY + f", l as (select *, " + ", ".join(f"lead(close, {h}) over w as c{h}, lead(open_ms, {h}) over w as t{h}" for h in (1, 6, 18)) + f" from bars window w as ({W})) select symbol, open_ms, " + ", ".join(f"case when t{h} = open_ms + {4 * h * HOUR} then round(ln(c{h} / close), 9) end as r{h}" for h in (1, 6, 18)) + " from l")
def horizon_returns(spark, sf_dir):
    """Returns to several horizons, null where the row that far ahead is not at that time."""
    b, w = four_hourly(spark, sf_dir), _along()
    for h in (1, 6, 18):
        b = b.withColumn(f"r{h}", F.when(F.lead("open_ms", h).over(w) == F.col("open_ms") + 4 * h * HOUR, F.round(F.ln(F.lead("close", h).over(w) / F.col("close")), 9)))
    return b.select("symbol", "open_ms", "r1", "r6", "r18")


@query("placebo_levels", FOUR_HOURLY + ", o(d) as (values (-5), (-10), (5), (10)) select symbol, open_ms, d, cast(close + round_even(cast(close * (high - low) * d as decimal(38,4)) / 100000, 0) as bigint) as level from bars, o where close + round_even(cast(close * (high - low) * d as decimal(38,4)) / 100000, 0) > 0")
def placebo_levels(spark, sf_dir):
    """Each level moved by tenths of its range either way; moved ones below zero are left out."""
    b = four_hourly(spark, sf_dir).withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-5, -10, 5, 10)])))
    moved = (F.col("close") + F.bround((F.col("close") * (F.col("high") - F.col("low")) * F.col("d")).cast("decimal(28,4)") / F.lit(100_000).cast("decimal(6,0)"), 0)).cast("long")
    return b.select("symbol", "open_ms", "d", moved.alias("level")).where("level > 0")


@query("level_base_rates", f"with {TRADES}, d as (select symbol, ms // {DAY} as d, max(price) as h, min(price) as l, arg_max(price, id) as c from trades group by 1, 2), p as (select *, lag(h) over w as ph, lag(l) over w as pl from d window w as (partition by symbol order by d)) select symbol, count(ph) as days, count(*) filter (where h >= ph) as touched_high, count(*) filter (where l <= pl) as touched_low, count(*) filter (where h >= ph and c < ph) as rejected_high, round(count(*) filter (where h >= ph) / count(ph)::double, 9) as rate from p group by 1")
def level_base_rates(spark, sf_dir):
    """How often a day reaches the high and low of the day before, and closes back inside."""
    d = trades(spark, sf_dir).groupBy("symbol", F.floor(F.col("ms") / DAY).alias("d")).agg(F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "id").alias("c"))
    w = Window.partitionBy("symbol").orderBy("d")
    p = d.withColumn("ph", F.lag("h").over(w)).withColumn("pl", F.lag("l").over(w))
    high = F.col("h") >= F.col("ph")
    return p.groupBy("symbol").agg(
        F.count("ph").alias("days"), F.count_if(high).alias("touched_high"), F.count_if(F.col("l") <= F.col("pl")).alias("touched_low"), F.count_if(high & (F.col("c") < F.col("ph"))).alias("rejected_high"), rounded(F.count_if(high) / F.count("ph"), "rate", 9)
    )


@query("last_run_inputs", HOURLY + f", g as (select *, coalesce(lead(open_ms) over ({W}) - open_ms <> {HOUR}, false)::int as gap from bars), r as (select *, sum(gap) over (partition by symbol order by open_ms desc) as run from g) select symbol, open_ms, round(ln(close / lag(close) over ({W})), 9) as ret, cast(sum(quote) over ({W} rows between 4 preceding and current row) as bigint) as notional5 from r where run = 0")
def last_run_inputs(spark, sf_dir):
    """Returns and trailing notionals within each symbol's last stretch without a gap."""
    rows = evidence.last_run(hourly(spark, sf_dir), "symbol", "open_ms", HOUR)
    w = _along()
    return rows.select("symbol", "open_ms", rounded(F.ln(F.col("close") / F.lag("close").over(w)), "ret", 9), F.sum("quote").over(w.rowsBetween(-4, 0)).alias("notional5"))


# -- wallets and references


@query("position_terms", FOUR_HOURLY + ", f as (select symbol, open_ms, case when first_id % 2 = 0 then 1 else -1 end as side, open::double as o, high::double as h, low::double as l from bars), e as (select *, o + side * greatest(o * 0.0001::double, (h - l) * 0.1::double) as fill from f), n as (select *, 0.0105::double + 3 * abs(fill - (o - side * (h - l + 1))) * (1 - side * 0.0105::double) / fill as need from e), t as (select *, case when least(20, floor(1 / need)) >= 1 then least(20, floor(1 / need)) end as lev from n) select symbol, open_ms, round(fill, 6) as fill, cast(lev as int) as leverage, round((fill / lev - side * fill) / (0.0105::double - side), 6) as liquidation from t")
def position_terms(spark, sf_dir):
    """Fill, leverage that keeps liquidation beyond the stop with the closing fee reserved, and liquidation price."""
    from dataclasses import replace

    b = four_hourly(spark, sf_dir).select("symbol", "open_ms", F.when(F.col("first_id") % 2 == 0, 1).otherwise(-1).alias("side"), *[F.col(c).cast("double").alias(n) for c, n in (("open", "o"), ("high", "h"), ("low", "l"))])
    side, o, h, l = (F.col(c) for c in ("side", "o", "h", "l"))
    rule = replace(costs.V1, mmr=costs.V1.mmr + costs.V1.taker)
    e = b.withColumn("fill", costs.entry_fill(side, o, h, l))
    e = e.withColumn("leverage", costs.max_leverage(side, F.col("fill"), F.abs(F.col("fill") - (o - side * (h - l + 1))), rule))
    return e.select("symbol", "open_ms", rounded(F.col("fill"), "fill"), "leverage", rounded(costs.liquidation_price(side, F.col("fill"), F.col("leverage"), rule.mmr), "liquidation"))


@query("random_walk_share", "select l_suppkey % 7 as mode, round(1 / 3.0::double, 9) as expected, round(count(*) filter (where l_returnflag = 'R') / nullif(count(*) filter (where l_returnflag in ('R', 'A')), 0), 9) as observed, count(*) filter (where l_returnflag = 'R') as targets, count(*) filter (where l_returnflag = 'A') as stops from lineitem group by 1")
def random_walk_share(spark, sf_dir):
    """The share of targets among targets and stops against 1 / (1 + reward to risk), with two to one."""
    hit, stop = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") == "A")
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("mode")).agg(F.lit(round(1 / 3, 9)).alias("expected"), rounded(F.try_divide(hit, hit + stop), "observed", 9), hit.alias("targets"), stop.alias("stops"))


@query("always_side", "select case when l_linenumber % 2 = 1 then 1 else -1 end as side, count(*) as n, round(avg(l_discount - l_tax), 9) as mean, count(*) filter (where l_discount > l_tax) as wins from lineitem where l_returnflag <> 'N' group by 1")
def always_side(spark, sf_dir):
    """What always taking one side would have made."""
    net = F.col("l_discount") - F.col("l_tax")
    side = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1)
    return read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(net), "mean", 9), F.count_if(net > 0).alias("wins"))


@query("yearly_periods", "with d as (select cast(o_orderdate as date) as day, sum(o_totalprice) as v, count(distinct o_orderpriority) as p from orders group by 1) select year(day) as period, count(*) as days, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as deviation, round(avg(p), 9) as active from d group by 1 union all select 0, count(*), round(avg(v), 4), round(stddev_samp(v), 4), round(avg(p), 9) from d where year(day) < 1996")
def yearly_periods(spark, sf_dir):
    """Statistics of the daily stream by year, and of all days before a year, which counts as period 0."""
    d = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"), F.countDistinct("o_orderpriority").alias("p")).withColumn("year", F.year("day"))
    stats = [F.count(F.lit(1)).alias("days"), rounded(F.avg("v"), "mean", 4), rounded(F.stddev_samp("v"), "deviation", 4), rounded(F.avg("p"), "active", 9)]
    return d.groupBy(F.col("year").cast("long").alias("period")).agg(*stats).unionByName(d.where("year < 1996").agg(F.lit(0).cast("long").alias("period"), *stats))


@query("short_spans", HOURLY + f", g as (select *, coalesce(open_ms - lag(open_ms) over ({W}) <> {HOUR}, true)::int as new from bars), r as (select *, sum(new) over ({W}) as run from g), s as (select symbol, run, max(open_ms) - min(open_ms) as span from r group by 1, 2) select symbol, count(*) as spans, count(*) filter (where span < {3 * HOUR}) as short from s group by 1")
def short_spans(spark, sf_dir):
    """Stretches without a gap, and how many of them are shorter than three hours."""
    w = _along()
    new = F.coalesce((F.col("open_ms") - F.lag("open_ms").over(w) != HOUR).cast("int"), F.lit(1))
    r = hourly(spark, sf_dir).select("symbol", "open_ms", new.alias("new")).withColumn("run", F.sum("new").over(w))
    s = r.groupBy("symbol", "run").agg((F.max("open_ms") - F.min("open_ms")).alias("span"))
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("span") < 3 * HOUR).alias("short"))


@query("grid_outcomes", HOURLY + f", e as (select symbol, min(open_ms) // {DAY} * {DAY} + {DAY} as a, max(open_ms) as b from bars group by 1), s as (select symbol, unnest(range(a, b, {6 * HOUR})) as at from e) select s.symbol, s.at, round(ln(y.close / x.close), 9) as ret from s left join bars x on x.symbol = s.symbol and x.open_ms = s.at left join bars y on y.symbol = s.symbol and y.open_ms = s.at + {6 * HOUR}")
def grid_outcomes(spark, sf_dir):
    """Outcomes on a grid whose windows don't overlap; null where either end is missing."""
    b = hourly(spark, sf_dir).select("symbol", "open_ms", "close")
    ends = b.groupBy("symbol").agg((F.min(calendar.day(F.col("open_ms"))) + DAY).alias("a"), (F.max("open_ms") - 1).alias("b"))
    s = ends.where("a <= b").select("symbol", F.explode(F.sequence("a", "b", F.lit(6 * HOUR))).alias("at"))
    x = b.select("symbol", F.col("open_ms").alias("at"), F.col("close").alias("x"))
    y = b.select("symbol", (F.col("open_ms") - 6 * HOUR).alias("at"), F.col("close").alias("y"))
    return s.join(x, ["symbol", "at"], "left").join(y, ["symbol", "at"], "left").select("symbol", "at", rounded(F.ln(F.col("y") / F.col("x")), "ret", 9))


# -- statistics


@query("weighted_slopes", "with k as (select l_suppkey % 7 as mode, l_quantity::double as x, case when l_linenumber <> 5 then l_extendedprice end as y, (l_linenumber - 1)::double as w from lineitem), s as (select * from k where w > 0 and y is not null) select mode, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 4) as slope from s group by 1")
def weighted_slopes(spark, sf_dir):
    x, w = F.col("l_quantity").cast("double"), (F.col("l_linenumber") - 1).cast("double")
    y = F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("mode")).agg(rounded(evidence.weighted_slope(x, y, w), "slope", 4))


@query("spearman", "with r as (select l_suppkey % 7 as mode, rank() over (partition by l_suppkey % 7 order by l_quantity) + (count(*) over (partition by l_suppkey % 7, l_quantity) - 1) / 2.0::double as a, rank() over (partition by l_suppkey % 7 order by l_extendedprice) + (count(*) over (partition by l_suppkey % 7, l_extendedprice) - 1) / 2.0::double as b from lineitem) select mode, round(corr(a, b), 6) as rho from r group by 1")
def spearman(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("mode"), "l_quantity", "l_extendedprice")
    ranks = rows.select("mode", evidence.average_rank("l_quantity", ["mode"]).alias("a"), evidence.average_rank("l_extendedprice", ["mode"]).alias("b"))
    return ranks.groupBy("mode").agg(rounded(F.corr("a", "b"), "rho"))


@query("within_regression", "with r as (select l_suppkey as c, l_extendedprice - avg(l_extendedprice) over (partition by l_linenumber) as y, l_quantity - avg(l_quantity) over (partition by l_linenumber) as x from lineitem), t as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as sxx from r), s as (select c, sum(x * (y - beta * x)) as score, count(*) as n from r, t group by c) select round(max(beta), 4) as beta, round(sqrt(sum(score * score) * count(*) / (count(*) - 1)) / max(sxx), 4) as se, count(*) as clusters, sum(n)::bigint as n from s, t")
def within_regression(spark, sf_dir):
    """Price on quantity with fixed effects of the line's place and errors clustered by supplier."""
    r = evidence.within_slope(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_linenumber", "l_suppkey")
    return r.select(rounded(F.col("beta"), "beta", 4), rounded(F.col("se"), "se", 4), "clusters", "n")


_BOOT = "r as (select unnest(range(0, 50)) as replicate), p as (select r.replicate, cast(floor(cast('0x' || substr(sha256('7|{s}|' || r.replicate || '|' || c.i), 1, 13) as bigint) / 4503599627370496.0::double * (select count(*) from c)) as bigint) as i from r, c) select p.replicate, round(sum(c.total) / sum(c.n), 9) as mean from p join c on c.i = p.i group by 1"


@query("day_bootstrap", "with d as (select cast(l_shipdate as date) as day, sum(l_discount - l_tax) as total, count(*) as n from lineitem group by 1), c as (select row_number() over (order by day) - 1 as i, total, n from d), " + _BOOT.format(s="day"))
def day_bootstrap(spark, sf_dir):
    """Means over days drawn with replacement; days are numbered in one window, as there is one row per day."""
    d = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_discount") - F.col("l_tax")).alias("total"), F.count(F.lit(1)).alias("n"))
    c = d.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("i"), "total", "n")
    return evidence.cluster_bootstrap(c, 50, 7, "day").select("replicate", rounded(F.col("mean"), "mean", 9))


@query("month_bootstrap", "with d as (select date_trunc('month', l_shipdate) as m, sum(l_discount - l_tax) as total, count(*) as n from lineitem group by 1), c as (select row_number() over (order by m) - 1 as i, total, n from d), " + _BOOT.format(s="month"))
def month_bootstrap(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("m")).agg(F.sum(F.col("l_discount") - F.col("l_tax")).alias("total"), F.count(F.lit(1)).alias("n"))
    c = d.select((F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("i"), "total", "n")
    return evidence.cluster_bootstrap(c, 50, 7, "month").select("replicate", rounded(F.col("mean"), "mean", 9))
