"""Queries that write month files and archives from the driver's tables and read them back strictly, with their SQL."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.exact import render_scaled
from ..operators import bars
from ..sources import archives, lake
from .tables import DAY, HOUR, HOURLY, TRADES, bars_sql, hourly, read, trades

QUERIES, SQL = {}, {}
BARS = "open_time_ms long, open string, high string, low string, close string, volume string, trades long, premium_close string, index_close string, flags int"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _cents(value):
    """Cents as decimal text."""
    return render_scaled(value * 1_000_000)


# every hour of every month that a symbol has a trade in
_GRID = HOURLY + f""",
m as (select distinct symbol, date_trunc('month', make_timestamp(open_ms * 1000)) as m from bars),
g as (select symbol, unnest(range(epoch_ms(m), epoch_ms(m + interval 1 month), {HOUR})) as open_ms from m)"""


def _month_files(spark, sf_dir) -> str:
    b = hourly(spark, sf_dir)
    month = lake.month_of(F.col("open_ms"))
    months = b.select("symbol", month.alias("month")).distinct()
    step = F.lit(HOUR).cast("long")
    grid = months.select("symbol", "month", F.explode(F.sequence(lake.month_start(F.col("month")), lake.month_end(F.col("month")) - step, step)).alias("open_ms"))
    rows = grid.join(b, ["symbol", "open_ms"], "left")
    empty, odd = F.col("close").isNull(), F.coalesce(F.col("close") % 7 == 0, F.lit(True))
    made = rows.select(
        "symbol", "month", F.col("open_ms").alias("open_time_ms"), *[_cents(F.col(c) + 100).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume"), F.lit(0)).cast("string").alias("volume"),
        F.coalesce("trades", F.lit(0)).alias("trades"), F.when(~odd, render_scaled(F.col("close") - 15_000)).alias("premium_close"), _cents(F.col("close") + 99).alias("index_close"),
        (F.when(empty, bars.NO_TRADES).otherwise(0) + F.when(odd, lake.PREMIUM_MISSING).otherwise(0)).alias("flags"),
    )
    path = lake.work_path(spark, "bars")
    lake.write_months(made, path, "open_time_ms", _names(BARS))
    return path


@query("lake_bars", _GRID + " select symbol, open_ms, (open + 100) * 1000000 as open, (high + 100) * 1000000 as high, (low + 100) * 1000000 as low, (close + 100) * 1000000 as close, coalesce(volume, 0) * 100000000 as volume, coalesce(trades, 0) as trades, case when close is null then 1 else 0 end + case when coalesce(close % 7 = 0, true) then 32 else 0 end as flags from g left join bars using (symbol, open_ms)")
def lake_bars(spark, sf_dir):
    """Whole months of bars through gzip CSV files: one row per hour, missing prices missing."""
    return lake.bars_month(lake.read_csv_months(spark, _month_files(spark, sf_dir), BARS), 60)


@query("lake_premium", _GRID + " select symbol, open_ms, case when close % 7 <> 0 then close - 15000 end as premium_close, (close + 99) * 1000000 as index_close from g left join bars using (symbol, open_ms)")
def lake_premium(spark, sf_dir):
    """Premium and index close of the same files in one pass over the columns needed."""
    return lake.premium_month(lake.read_csv_months(spark, _month_files(spark, sf_dir), BARS), 60)


@query("lake_funding", HOURLY + f" select symbol, open_ms + trades % 3 as calc_time_ms, 8 as interval_hours, (close % 200 - 100) * 100 as rate from bars where open_ms % {8 * HOUR} = 0")
def lake_funding(spark, sf_dir):
    rate = render_scaled((F.col("close") % 200 - 100) * 100)
    t = F.col("open_ms") + F.col("trades") % 3
    rows = hourly(spark, sf_dir).where(F.col("open_ms") % (8 * HOUR) == 0).select("symbol", lake.month_of(t).alias("month"), t.alias("calc_time_ms"), F.lit(8).alias("funding_interval_hours"), rate.alias("last_funding_rate"), rate.alias("last_funding_rate_published"))
    path = lake.work_path(spark, "funding")
    lake.write_months(rows, path, "calc_time_ms", _names(lake.FUNDING_COLUMNS))
    return lake.funding_months(lake.read_csv_months(spark, path, lake.FUNDING_COLUMNS))


def _zipped(spark, rows, key, order, schema, name) -> str:
    path = lake.work_path(spark, name)
    lake.write_zips(rows, key, order, _names(schema), path).write.format("noop").mode("overwrite").save()
    return path + "/*.zip"


@query("lake_daily", "with " + TRADES + ",\n" + bars_sql("bars", 1440) + " select symbol, open_ms, open * 1000000 as open, high * 1000000 as high, low * 1000000 as low, close * 1000000 as close, case when trades % 9 <> 0 then volume * 100000000 end as volume, trades from bars where open_ms < 1706745600000")
def lake_daily(spark, sf_dir):
    """Daily candles of a month through zip archives; volumes beyond 64 bits are missing."""
    t, v = F.col("open_ms"), F.col("volume").cast("string")
    d = bars.minute_bars(trades(spark, sf_dir), 1440)
    far = F.when(F.col("trades") % 9 == 0, F.concat(F.lit("9"), F.lpad(v, 12, "0"))).otherwise(v)
    rows = d.select(
        "symbol", lake.month_of(t).alias("month"), t.alias("open_time_ms"), *[_cents(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], far.alias("volume"), (t + DAY - 1).alias("close_time_ms"),
        _cents(F.col("quote")).alias("quote_volume"), "trades", F.col("taker_volume").cast("string").alias("taker_buy_volume"), F.lit("0").alias("taker_buy_quote_volume"), F.lit("0").alias("ignore"),
    )
    path = _zipped(spark, rows, ["symbol", "month"], "open_time_ms", archives.KLINE_COLUMNS, "daily")
    return lake.daily_klines(archives.read_zip_csv(spark, path, archives.KLINE_COLUMNS), "2024-01", "2024-01")


@query("lake_trades", "with " + TRADES + " select symbol, id, ms, price * 1000000 as price, qty * 100000000 as qty, maker, 1 as fills from trades")
def lake_trades(spark, sf_dir):
    """Trades through one zip per symbol and day; repeated rows of an id count once."""
    t = trades(spark, sf_dir)
    t = t.unionByName(t.where("id % 50 = 0"))
    maker = F.when(F.col("maker"), "true").otherwise("False")
    rows = t.select("symbol", calendar.day(F.col("ms")).alias("day"), F.col("id").alias("agg_trade_id"), _cents(F.col("price")).alias("price"), F.col("qty").cast("string").alias("quantity"), F.col("id").alias("first_trade_id"), F.col("id").alias("last_trade_id"), F.col("ms").alias("transact_time_ms"), maker.alias("is_buyer_maker"))
    path = _zipped(spark, rows, ["symbol", "day"], "agg_trade_id", archives.TRADE_COLUMNS, "trades")
    return archives.trades_of(archives.read_zip_csv(spark, path, archives.TRADE_COLUMNS), F.regexp_extract("file", r"([^/]+)-\d+\.zip$", 1))


@query("lake_metrics", HOURLY + f", s as (select distinct symbol from bars), g as (select symbol, unnest(range(1704067500000, 1706745900001, 300000)) as at_ms from s) select g.symbol, g.at_ms, b.volume::double as sum_open_interest from g left join bars b on b.symbol = g.symbol and b.open_ms = g.at_ms - 300000 and b.open_ms < 1706745600000")
def lake_metrics(spark, sf_dir):
    """Positioning metrics through daily zips in either form of time, on the dense grid at the time they may be used."""
    t, b = F.col("open_ms"), hourly(spark, sf_dir)
    day = calendar.day(t)
    text = F.when(day / DAY % 2 == 0, F.date_format(calendar.utc(t), "yyyy-MM-dd HH:mm:ss")).otherwise(t.cast("string"))
    values = [F.col(c).cast("double").alias(n) for n, c in zip(_names(archives.METRIC_COLUMNS)[2:], ("volume", "quote", "open", "high", "low", "close"), strict=True)]
    path = _zipped(spark, b.select("symbol", day.alias("day"), text.alias("create_time"), *values), ["symbol", "day"], "create_time", archives.METRIC_COLUMNS, "metrics")
    m = archives.metrics_of(archives.read_zip_csv(spark, path, archives.METRIC_COLUMNS))
    return lake.metrics_grid(m, "2024-01", "2024-01", ["2024-01"], "sum_open_interest")


@query("lake_labels", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 'T' else 'S' end as pess_outcome, cast(l_quantity as bigint) + 2 as pess_net, case when l_linenumber % 3 = 0 then 'T' when l_linenumber % 2 = 0 then 'T' else 'S' end as opt_outcome, cast(l_quantity as bigint) + 2 + case when l_linenumber % 3 = 0 then 7 else 0 end as opt_net from lineitem")
def lake_labels(spark, sf_dir):
    """Label files by kind and month: of each row's targets the second, pessimist and optimist."""
    l = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    outcome = F.when(F.col("l_linenumber") % 2 == 0, "T").otherwise("S")
    better = F.col("l_linenumber") % 3 == 0

    def cell(rr: int):
        pess = F.concat_ws(":", outcome, F.lit(rr), (q + rr).cast("string"), F.lit(1), F.lit(0))
        opt = F.concat_ws(":", F.lit("T"), F.lit(rr), (q + rr + 7).cast("string"), F.lit(1), F.lit(0))
        return F.when(better, F.concat_ws("|", pess, opt)).otherwise(pess)

    rows = l.select(F.col("l_returnflag").alias("symbol"), F.date_format("l_shipdate", "yyyy").alias("month"), "l_orderkey", "l_linenumber", F.concat_ws(";", cell(1), cell(2), cell(3)).alias("cells"))
    path = lake.work_path(spark, "labels")
    lake.write_months(rows, path, "l_orderkey", ["l_orderkey", "l_linenumber", "cells"])
    found = archives.labels_of(lake.read_csv_months(spark, path, "l_orderkey long, l_linenumber int, cells string"))
    c = F.element_at("cells", 2)
    return found.select("l_orderkey", "l_linenumber", c["pess"]["outcome"].alias("pess_outcome"), c["pess"]["net_ur"].alias("pess_net"), c["opt"]["outcome"].alias("opt_outcome"), c["opt"]["net_ur"].alias("opt_net"))


@query("candle_table_counts", _GRID + " select count(*) as rows, count(close) as valid, count(*) filter (where close > open) as rising from g left join bars using (symbol, open_ms)")
def candle_table_counts(spark, sf_dir):
    """Counts observed while a table is written, beside nothing that is read twice."""
    raw = lake.read_csv_months(spark, _month_files(spark, sf_dir), BARS)
    table, seen = lake.bars_month(raw, 60), Observation("candles")
    table = table.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("close").alias("valid"), F.count_if(F.col("close") > F.col("open")).alias("rising"))
    table.write.parquet(lake.work_path(spark, "candles"))
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["valid"], got["rising"])], "rows long, valid long, rising long")
