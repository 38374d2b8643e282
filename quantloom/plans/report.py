"""Report queries over orders, line items and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import ranks, reports
from .market import rounded
from .tables import DAY, FOUR_HOURLY, TRADES, four_hourly, read, trades

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


NET = "cast(round(l_extendedprice * (l_discount - l_tax) * 100) as bigint)"
_OUT = f"o as (select l_returnflag, l_linestatus, cast(l_shipdate as date) as day, {NET} as net, l_orderkey, l_linenumber, l_suppkey from lineitem)"


def outcomes(spark, sf_dir):
    """Line items as outcomes: flag and status as kinds, the ship date as the day, price * (discount - tax) in cents as the net."""
    l = read(spark, sf_dir, "lineitem")
    net = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
    return l.select("l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("day"), net.alias("net"), "l_orderkey", "l_linenumber", "l_suppkey")


def _moments_sql(group: str) -> str:
    return f"""d as (select {group}, day, count(net) as n, sum(net) as s, sum(cast(net as double) * net) as q from o group by {group}, day),
t as (select {group}, sum(n) as n, sum(s) as s, sum(q) as q, count(*) as days from d group by {group}),
e as (select {', '.join('d.' + g.strip() for g in group.split(','))}, sum(power(d.s - d.n * (t.s / t.n), 2)) as r from d join t using ({group}) group by {', '.join('d.' + g.strip() for g in group.split(','))})"""


@query("outcome_report", f"""with {_OUT}, {_moments_sql('l_returnflag, l_linestatus')}
select t.l_returnflag, t.l_linestatus, cast(n as bigint) as n, cast(s as bigint) as total, days, round(s / n, 4) as mean, round(sqrt(greatest((q - cast(s as double) * s / n) / (n - 1), 0) / n), 4) as se, round(sqrt(r) / n, 4) as clustered_se
from t join e using (l_returnflag, l_linestatus)""")
def outcome_report(spark, sf_dir):
    rows = reports.outcome_report(outcomes(spark, sf_dir).withColumn("net", F.col("net").cast("double")), ["l_returnflag", "l_linestatus"])
    return rows.select("l_returnflag", "l_linestatus", "n", F.col("total").cast("long").alias("total"), "days", *[rounded(F.col(c), c, 4) for c in ("mean", "se", "clustered_se")])


@query("paired_report", f"""with {_OUT}, a as (select l_returnflag, day, count(*) as n, sum(net) as s from o where l_linestatus = 'F' group by 1, 2), b as (select l_returnflag, day, count(*) as m, sum(net) as c from o where l_linestatus = 'O' group by 1, 2),
j as (select coalesce(a.l_returnflag, b.l_returnflag) as l_returnflag, coalesce(a.n, 0) as nd, coalesce(a.s, 0) as sd, coalesce(b.m, 0) as md, coalesce(b.c, 0) as cd from a full outer join b on a.l_returnflag = b.l_returnflag and a.day = b.day),
t as (select l_returnflag, sum(nd) as n, sum(sd) as s, sum(md) as m, sum(cd) as c, count(*) as days from j group by 1)
select j.l_returnflag, cast(t.n as bigint) as n, cast(t.m as bigint) as m, t.days, round(t.s / t.n - t.c / t.m, 4) as difference, round(sqrt(sum(power((sd - nd * (t.s / t.n)) / t.n - (cd - md * (t.c / t.m)) / t.m, 2))), 4) as se from j join t using (l_returnflag) where t.n > 0 and t.m > 0 group by 1, t.n, t.m, t.days, t.s, t.c""")
def paired_report(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("net", F.col("net").cast("double"))
    rows = reports.paired_report(o.where("l_linestatus = 'F'"), o.where("l_linestatus = 'O'"), ["l_returnflag"])
    return rows.select("l_returnflag", "n", "m", "days", rounded(F.col("difference"), "difference", 4), rounded(F.col("se"), "se", 4))


@query("nontrade_report", "select o_orderstatus, o_orderpriority, count(*) as n, count(*) filter (where o_orderkey not in (select l_orderkey from lineitem)) as without_outcome from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1, 2")
def nontrade_report(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where(reports.any_of("o_orderpriority", ["1-URGENT", "2-HIGH"]) & reports.any_of("o_orderstatus", []))
    known = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    rows = orders.join(known, "o_orderkey", "left")
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("without_outcome"))


@query("open_setups", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')")
def open_setups(spark, sf_dir):
    final = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(final, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("outcome_log", "select o_orderkey, o_orderstatus, l_linenumber, l_returnflag from orders join lineitem on l_orderkey = o_orderkey where l_linestatus = 'F'")
def outcome_log(spark, sf_dir):
    final = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return read(spark, sf_dir, "orders").join(final, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_returnflag")


_LEDGER = "l as (select o_custkey as account, epoch_us(o_orderdate) // 1000 as ms, o_orderkey as seq, o_orderstatus as type, cast(round(o_totalprice * 100) as bigint) * case o_orderstatus when 'F' then 1 when 'O' then -1 else 0 end as amount from orders), b as (select *, sum(amount) over (partition by account order by ms, seq) as balance from l)"


def ledger(spark, sf_dir):
    """Orders as ledger lines by customer: finished ones add, open ones take."""
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account"), calendar.epoch_ms(F.col("o_orderdate")).alias("ms"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("type"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * sign).alias("amount"),
    )
    return rows.withColumn("balance", F.sum("amount").over(Window.partitionBy("account").orderBy("ms", "seq")))


@query("ledger_summary", f"with {_LEDGER} select type, count(*) as lines, cast(sum(amount) as bigint) as amount from l group by type")
def ledger_summary(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("amount"))


@query("account_summary", f"with {_LEDGER}, e as (select account, arg_max(balance, seq) filter (where ms = m) as balance from (select *, max(ms) over (partition by account) as m from b) group by account) select count(*) as accounts, cast(sum(balance) as bigint) as balance, count(*) filter (where balance < 0) as below_zero, (select count(*) from l) as lines from e")
def account_summary(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    ends = rows.groupBy("account").agg(F.max_by("balance", F.struct("ms", "seq")).alias("balance"), F.count(F.lit(1)).alias("n"))
    return ends.agg(F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("balance"), F.count_if(F.col("balance") < 0).alias("below_zero"), F.sum("n").alias("lines"))


@query("equity_last_per_bucket", f"with {_LEDGER}, r as (select account, ms - ms % {30 * DAY} as bucket_ms, balance, row_number() over (partition by account, ms - ms % {30 * DAY} order by ms desc, seq desc) as k from b) select account, bucket_ms, cast(balance as bigint) as balance from r where k = 1")
def equity_last_per_bucket(spark, sf_dir):
    return reports.last_balance(ledger(spark, sf_dir), "account", "ms", "seq", "balance", 30 * DAY)


@query("ledger_drawdown", f"with {_LEDGER}, r as (select account, balance, greatest(max(balance) over (partition by account order by ms, seq), 0) - balance as fall from b) select account, cast(max(fall) as bigint) as drawdown, count(*) filter (where fall > 0) as below from r group by account")
def ledger_drawdown(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("at", F.struct("ms", "seq"))
    return reports.drawdown(rows, "account", "at", "amount")


@query("daily_zero_filled", f"with {_OUT}, d as (select l_returnflag, day, sum(net) as net from o group by 1, 2), e as (select l_returnflag, min(day) as a, max(day) as b from d group by 1), s as (select l_returnflag, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day from e) select s.l_returnflag, s.day, cast(coalesce(d.net, 0) as bigint) as net from s left join d on d.l_returnflag = s.l_returnflag and d.day = s.day")
def daily_zero_filled(spark, sf_dir):
    return reports.daily_series(outcomes(spark, sf_dir), "l_returnflag", "day", "net")


@query("nearest_rank", f"with {_OUT}, r as (select l_returnflag, net, row_number() over (partition by l_returnflag order by net) as k, count(*) over (partition by l_returnflag) as n from o) select l_returnflag, max(case when k = greatest(1, ceil(0.05::double * n)) then net end) as p05, max(case when k = greatest(1, ceil(0.5::double * n)) then net end) as p50, max(case when k = greatest(1, ceil(0.95::double * n)) then net end) as p95 from r group by 1")
def nearest_rank(spark, sf_dir):
    return ranks.nearest_ranks(outcomes(spark, sf_dir), ["l_returnflag"], "net", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query("trade_metrics", f"with {_OUT} select l_returnflag, l_linestatus, count(net) as n, count(*) filter (where net > 0) as wins, round(count(*) filter (where net > 0) / count(net), 6) as hit_rate, round(avg(case when net > 0 then net end) / -avg(case when net < 0 then net end), 6) as payoff, round(sum(case when net > 0 then net end) / -sum(case when net < 0 then net end), 6) as profit_factor from o group by 1, 2")
def trade_metrics(spark, sf_dir):
    rows = reports.trade_metrics(outcomes(spark, sf_dir), ["l_returnflag", "l_linestatus"])
    return rows.select("l_returnflag", "l_linestatus", "n", "wins", *[rounded(F.col(c), c) for c in ("hit_rate", "payoff", "profit_factor")])


@query("wilson_interval", f"with {_OUT}, c as (select l_suppkey, count(*)::double as n, count(*) filter (where net > 0) as w from o group by 1), p as (select l_suppkey, n, w / n as p, 1.959963984540054::double as z from c) select l_suppkey, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as high from p")
def wilson_interval(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("net") > 0).alias("w"))
    low, high = reports.wilson(F.col("w"), F.col("n").cast("double"))
    return rows.select("l_suppkey", rounded(low, "low"), rounded(high, "high"))


@query("state_runs", f"with {_LEDGER}, n as (select account, type, ms, seq, coalesce(type <> lag(type) over (partition by account order by ms, seq), true) as fresh from l), r as (select *, sum(case when fresh then 1 else 0 end) over (partition by account order by ms, seq) as run from n), c as (select account, type, run, count(*) as n from r group by 1, 2, 3) select account, type, count(*) as runs, round(avg(n), 6) as mean_length, max(n) as longest from c group by 1, 2")
def state_runs(spark, sf_dir):
    rows = reports.state_runs(ledger(spark, sf_dir), "account", ["ms", "seq"], "type")
    return rows.select("account", "type", "runs", rounded(F.col("mean_length"), "mean_length"), "longest")


@query("latest_per_key", "with r as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders) select o_custkey, o_orderkey from r where rank = 1")
def latest_per_key(spark, sf_dir):
    rows = reports.newest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return rows.select("o_custkey", "o_orderkey")


@query("retention_topn", "with r as (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from events) select event_type, event_id, rank from r where rank <= 260")
def retention_topn(spark, sf_dir):
    rows = reports.newest(read(spark, sf_dir, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 260)
    return rows.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query("ranked_due_union", "with d as (select 'generate' as work, o_orderpriority as frame, o_orderkey as id, o_orderdate as due from orders where o_orderstatus = 'O' union all select 'resolve', o_orderpriority, o_orderkey, o_orderdate from orders where o_orderstatus = 'P'), r as (select *, row_number() over (partition by work, frame order by due, id) as rank from d) select work, frame, id, rank from r where rank <= 500")
def ranked_due_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    parts = [o.where(F.col("o_orderstatus") == s).select(F.lit(w).alias("work"), F.col("o_orderpriority").alias("frame"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due")) for s, w in (("O", "generate"), ("P", "resolve"))]
    rows = reports.newest(parts[0].unionByName(parts[1]), ["work", "frame"], [F.col("due"), F.col("id")], 500)
    return rows.select("work", "frame", "id", F.col("rank").cast("long").alias("rank"))


@query("keyset_page", "select o_orderkey, o_orderdate from orders where (o_orderdate, o_orderkey) < (timestamp '1998-01-01 00:00:00', 0) order by o_orderdate desc, o_orderkey desc limit 50")
def keyset_page(spark, sf_dir):
    cursor = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return reports.page(read(spark, sf_dir, "orders"), cursor, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50).select("o_orderkey", "o_orderdate")


@query("stratified_sample", "with r as (select o_orderpriority, o_orderstatus, o_orderkey, row_number() over (partition by o_orderpriority, o_orderstatus order by sha256('7|' || cast(o_orderkey as varchar)), o_orderkey) as rank from orders) select o_orderpriority, o_orderstatus, o_orderkey, rank from r where rank <= 20")
def stratified_sample(spark, sf_dir):
    rows = reports.stratified_sample(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 20, "7")
    return rows.select("o_orderpriority", "o_orderstatus", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("evenly_spaced_sample", "with r as (select event_type, event_id, ntile(40) over (partition by event_type order by event_id) as part from events) select event_type, part, min(event_id) as event_id from r group by 1, 2")
def evenly_spaced_sample(spark, sf_dir):
    rows = reports.evenly_spaced(read(spark, sf_dir, "events"), ["event_type"], "event_id", 40)
    return rows.select("event_type", F.col("part").cast("long").alias("part"), "event_id")


@query("top_leads", f"with {_OUT}, m as (select l_returnflag, l_suppkey, count(*) as n, avg(net) as mean from o group by 1, 2), r as (select *, row_number() over (partition by l_returnflag order by mean desc, l_suppkey) as rank from m where n >= 5) select l_returnflag, l_suppkey, n, round(mean, 4) as mean, rank from r where rank <= 5")
def top_leads(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean")).where("n >= 5")
    rows = reports.newest(rows, ["l_returnflag"], [F.col("mean").desc(), F.col("l_suppkey")], 5)
    return rows.select("l_returnflag", "l_suppkey", "n", rounded(F.col("mean"), "mean", 4), F.col("rank").cast("long").alias("rank"))


@query("union_trading_days", f"with {_OUT} select day from o where l_linestatus = 'F' and l_returnflag = 'A' union select day from o where l_linestatus = 'O' and l_returnflag = 'N'")
def union_trading_days(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    return o.where("l_linestatus = 'F' and l_returnflag = 'A'").select("day").union(o.where("l_linestatus = 'O' and l_returnflag = 'N'").select("day")).distinct()


@query("z_stats_by_hour", FOUR_HOURLY + ", r as (select symbol, open_ms, ln(close / lag(close) over (partition by symbol order by open_ms)) as r from bars), z as (select (open_ms % 86400000) // 3600000 as hour, r / stddev_samp(r) over (partition by symbol) as z from r) select cast(hour as int) as hour, count(z) as n, round(stddev_samp(z), 6) as sd, round(avg(abs(z)), 6) as mean_abs, round(count(*) filter (where abs(z) > 1) / count(z), 6) as beyond_1, round(count(*) filter (where abs(z) > 2) / count(z), 6) as beyond_2, round(count(*) filter (where abs(z) > 3) / count(z), 6) as beyond_3 from z group by 1")
def z_stats_by_hour(spark, sf_dir):
    from ..operators import rolling

    rows = four_hourly(spark, sf_dir).withColumn("r", rolling.log_return(F.col("close")))
    rows = rows.withColumn("z", F.col("r") / F.stddev_samp("r").over(Window.partitionBy("symbol"))).withColumn("hour", calendar.hour(F.col("open_ms")))
    out = reports.z_statistics(rows, ["hour"], "z")
    return out.select("hour", "n", *[rounded(F.col(c), c) for c in ("sd", "mean_abs", "beyond_1", "beyond_2", "beyond_3")])


_P = f"with {_OUT}, s as (select l_suppkey, count(*) as n, count(*) filter (where net > 0) / count(*)::double as p from o group by 1), p as (select l_suppkey, round(p, 9) + l_suppkey * 1e-12::double as p from s)"


def _pvalues(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("net") > 0).alias("w"))
    return rows.select("l_suppkey", (F.round(F.col("w") / F.col("n"), 9) + F.col("l_suppkey") * 1e-12).alias("p"))


@query("holm", _P + ", r as (select *, row_number() over (order by p) as k, count(*) over () as m from p) select l_suppkey, round(least(1.0::double, max((m - k + 1) * p) over (order by p rows unbounded preceding)), 6) as holm from r")
def holm(spark, sf_dir):
    return reports.holm(_pvalues(spark, sf_dir), "p").select("l_suppkey", rounded(F.col("holm"), "holm"))


@query("bh_qvalues", _P + ", r as (select *, row_number() over (order by p) as k, count(*) over () as m from p) select l_suppkey, round(least(1.0::double, min(m * p / k) over (order by p rows between current row and unbounded following)), 6) as q from r")
def bh_qvalues(spark, sf_dir):
    return reports.benjamini_hochberg(_pvalues(spark, sf_dir), "p").select("l_suppkey", rounded(F.col("q"), "q"))


@query("weighted_quantiles", "with r as (select l_returnflag, l_quantity, sum(l_linenumber) over (partition by l_returnflag order by l_quantity) as c, sum(l_linenumber) over (partition by l_returnflag) as t from lineitem) select l_returnflag, min(l_quantity) as l_quantity from r where c >= 0.75::double * t group by 1")
def weighted_quantiles(spark, sf_dir):
    return reports.weighted_quantile(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber", 0.75)


@query("dose_response", "with r as (select value, user_id, event_id, ntile(5) over (order by value, event_id) as bucket from events) select bucket, count(*) as n, min(value) as lowest, max(value) as highest, round(avg(user_id), 6) as mean from r group by 1")
def dose_response(spark, sf_dir):
    rows = reports.dose_response(read(spark, sf_dir, "events"), "value", "user_id", key="event_id")
    return rows.select(F.col("bucket").cast("long").alias("bucket"), "n", "lowest", "highest", rounded(F.col("mean"), "mean"))


@query("stratified_difference", f"with {_OUT}, c as (select l_suppkey, l_returnflag, count(*) filter (where l_linestatus = 'F') as n, count(*) filter (where l_linestatus <> 'F') as m, avg(case when l_linestatus = 'F' then net end) as a, avg(case when l_linestatus <> 'F' then net end) as b from o group by 1, 2) select count(*) as strata, cast(sum(n) as bigint) as members, round(sum((a - b) * n) / sum(n), 4) as difference from c where n > 0 and m > 0")
def stratified_difference(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("member", F.col("l_linestatus") == "F")
    out = reports.stratified_difference(rows, ["l_suppkey", "l_returnflag"], "member", "net")
    return out.select("strata", "members", rounded(F.col("difference"), "difference", 4))


@query("grouping_sets", "select o_orderstatus, o_orderpriority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as level, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"))


@query("conflict_rows", "with s as (select o_custkey, o_orderpriority, min(o_orderkey) as k from orders group by 1, 2), a as (select o.o_custkey, o.o_orderpriority, o.o_orderstatus, o.o_totalprice from orders o join s on o.o_orderkey = s.k), b as (select orders.o_custkey, orders.o_orderpriority, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as st, case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as pr from orders join s on o_orderkey = s.k) select o_custkey, o_orderpriority, concat_ws(',', case when st <> o_orderstatus then 'o_orderstatus' end, case when pr <> o_totalprice then 'o_totalprice' end) as fields from a join b using (o_custkey, o_orderpriority) where st <> o_orderstatus or pr <> o_totalprice")
def conflict_rows(spark, sf_dir):
    key = ["o_custkey", "o_orderpriority"]
    stored = reports.newest(read(spark, sf_dir, "orders"), key, [F.col("o_orderkey")])
    k = F.col("o_orderkey")
    offered = stored.withColumn("o_orderstatus", F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return reports.conflicts(stored, offered, key, ["o_orderstatus", "o_totalprice"]).select(*key, F.array_join("fields", ",").alias("fields"))


@query("day_balanced_terciles", f"with {_OUT}, w as (select net, 1 / count(*) over (partition by day)::double as w from o), c as (select net, sum(w) as w from w group by 1), r as (select net, sum(w) over (order by net) as c, sum(w) over () as t from c) select min(case when c * 3 >= t - 1e-9::double then net end) as tercile_1, min(case when c * 3 >= 2 * t - 1e-9::double then net end) as tercile_2 from r")
def day_balanced_terciles(spark, sf_dir):
    return reports.day_balanced_terciles(outcomes(spark, sf_dir), "day", "net")


@query("state_counts", "select 'orders' as kind, o_orderstatus as state, count(*) as n from orders group by 2 union all select 'lines', l_linestatus, count(*) from lineitem group by 2 union all select 'events', event_type, count(*) from events group by 2")
def state_counts(spark, sf_dir):
    parts = [read(spark, sf_dir, t).groupBy(F.lit(k).alias("kind"), F.col(c).alias("state")).agg(F.count(F.lit(1)).alias("n")) for t, k, c in (("orders", "orders", "o_orderstatus"), ("lineitem", "lines", "l_linestatus"), ("events", "events", "event_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("funding_semi_accounts", "select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def funding_semi_accounts(spark, sf_dir):
    owing = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(owing, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("movement_history_arrays", "select event_type, count(*) as n, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from events group by 1")
def movement_history_arrays(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return rows.select("event_type", "n", F.array_join("ids", ",").alias("ids"))


@query("cross_section_breadth", f"with {TRADES}, b as (select symbol, ms - ms % {DAY} as d, arg_min(price, id) as o, arg_max(price, id) as c from trades group by 1, 2) select d as day_ms, count(*) as n, count(*) filter (where c > o) as rising, count(*) filter (where c < o) as falling, round(count(*) filter (where c > o) / count(*)::double, 6) as rising_share, median(c / o - 1) as median_return from b group by 1")
def cross_section_breadth(spark, sf_dir):
    from ..operators import movement

    rows = trades(spark, sf_dir).groupBy("symbol", calendar.day(F.col("ms")).alias("day_ms")).agg(F.min_by("price", "id").alias("o"), F.max_by("price", "id").alias("c"))
    return movement.breadth(rows.withColumn("ret", F.col("c") / F.col("o") - 1), "day_ms")


@query("cross_section_mad_z", f"with {TRADES}, b as (select symbol, ms - ms % {DAY} as day_ms, arg_max(price, id) / arg_min(price, id) - 1 as ret from trades group by 1, 2), m as (select day_ms, median(ret) as mid from b group by 1), a as (select b.day_ms, median(abs(b.ret - m.mid)) as mad from b join m using (day_ms) group by 1) select b.symbol, b.day_ms, case when a.mad > 0 then round(0.6745::double * (b.ret - m.mid) / a.mad, 6) end as z from b join m using (day_ms) join a using (day_ms)")
def cross_section_mad_z(spark, sf_dir):
    from ..operators import movement

    rows = trades(spark, sf_dir).groupBy("symbol", calendar.day(F.col("ms")).alias("day_ms")).agg(F.min_by("price", "id").alias("o"), F.max_by("price", "id").alias("c"))
    out = movement.cross_z(rows.withColumn("ret", F.col("c") / F.col("o") - 1), "day_ms", "ret")
    return out.select("symbol", "day_ms", rounded(F.col("z"), "z"))
