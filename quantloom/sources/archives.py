"""Scans of archived market files and text parsers, as Spark data sources and columns."""

from __future__ import annotations

import csv
import io
import lzma
import struct
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the public archive files.
TRADE_COLUMNS = "agg_trade_id long, price string, quantity string, first_trade_id long, last_trade_id long, transact_time_ms long, is_buyer_maker string"
KLINE_COLUMNS = "open_time_ms long, open string, high string, low string, close string, volume string, close_time_ms long, quote_volume string, trades long, taker_buy_volume string, taker_buy_quote_volume string, ignore string"
METRIC_COLUMNS = "create_time string, symbol string, sum_open_interest double, sum_open_interest_value double, count_toptrader_long_short_ratio double, sum_toptrader_long_short_ratio double, count_long_short_ratio double, sum_taker_long_short_vol_ratio double"
_TICK = struct.Struct(">IIIff")


def zip_rows(data: bytes, fields: int) -> Iterator[list[str]]:
    """The rows of a zip's one CSV member; a first line that begins with no integer is a header; every row has ``fields`` fields."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        (member,) = archive.namelist()
        with archive.open(member) as f:
            for k, row in enumerate(csv.reader(io.TextIOWrapper(f, "utf-8"))):
                if k == 0 and row and not row[0].lstrip("-").isdigit():
                    continue
                if len(row) != fields:
                    raise ValueError(f"{member}: line {k + 1} has {len(row)} fields, not {fields}")
                yield row


def read_zip_csv(spark: SparkSession, path: str, schema: str, lines: int = 50_000) -> DataFrame:
    """Zipped CSV files as rows with their ``file``; files are read by Spark, one task per some files, and parsed in portions."""
    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                held: list[list[str]] = []
                for row in zip_rows(bytes(data), len(names)):
                    held.append(row)
                    if len(held) >= lines:
                        yield pd.DataFrame(held, columns=names).assign(file=name)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names).assign(file=name)

    text = ", ".join(f"`{n}` string" for n in names) + ", file string"
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, text)
    return raw.select("file", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields])


def trades_of(raw: DataFrame, symbol: Column) -> DataFrame:
    """Archive trades as (symbol, id, ms, price, qty, maker) with exact scaled numbers, the first row of each id."""
    from ..functions.exact import parse_scaled

    rows = raw.select(
        symbol.alias("symbol"), F.col("agg_trade_id").alias("id"), F.col("transact_time_ms").alias("ms"), parse_scaled(F.col("price")).cast("long").alias("price"),
        parse_scaled(F.col("quantity")).cast("long").alias("qty"), (F.lower("is_buyer_maker") == "true").alias("maker"), (F.col("last_trade_id") - F.col("first_trade_id") + 1).alias("fills"),
    )
    return rows.dropDuplicates(["symbol", "id"])


def metrics_of(raw: DataFrame) -> DataFrame:
    """Positioning metrics: either timestamp form, usable five minutes later, the first row of each time."""
    at = F.coalesce(F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd HH:mm:ss")), F.timestamp_millis(F.col("create_time").try_cast("long")))
    ms = F.unix_millis(at)
    rows = raw.select("symbol", ms.alias("create_time_ms"), (ms + 300_000).alias("usable_from_ms"), *[c for c in raw.columns if c not in ("file", "symbol", "create_time")])
    return rows.where("create_time_ms is not null").dropDuplicates(["symbol", "create_time_ms"])


def ticks(data: bytes, hour_ms: int, divisor: int) -> list[tuple[int, int, int, float, float]]:
    """(ms, ask, bid, ask volume, bid volume) of an LZMA tick file: 20-byte big-endian records; prices times 10**8 / divisor are exact integers."""
    raw = lzma.decompress(data) if data else b""
    if len(raw) % _TICK.size:
        raise ValueError("a tick file ends within a record")
    factor = 10**8 // divisor
    return [(hour_ms + ms, ask * factor, bid * factor, av, bv) for ms, ask, bid, av, bv in _TICK.iter_unpack(raw)]


def read_ticks(spark: SparkSession, path: str, divisor: int, hour_of) -> DataFrame:
    """Tick files by path; ``hour_of(path)`` gives the hour's start in milliseconds."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(ticks(bytes(data), hour_of(name), divisor), columns=["ms", "ask", "bid", "ask_volume", "bid_volume"]).assign(file=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "ms long, ask long, bid long, ask_volume double, bid_volume double, file string")


def klines_of(raw: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """REST candle payloads of three exchanges as (open_ms, open, high, low, close, volume); other columns are carried."""
    from ..functions.exact import positive

    others = [c for c in raw.columns if c != body]
    if provider == "binance":
        rows = raw.select(*others, F.explode(F.from_json(body, "array<array<string>>")).alias("k"))
        place = {"open_ms": 0, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}
        at = F.col("k")[0].try_cast("long")
    elif provider == "okx":
        rows = raw.select(*others, F.explode(F.from_json(body, "data array<array<string>>")["data"]).alias("k"))
        rows = rows.where(F.coalesce(F.col("k")[8], F.lit("1")) == "1")  # finished candles only
        place = {"open_ms": 0, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}
        at = F.col("k")[0].try_cast("long")
    elif provider == "kraken":
        result = F.from_json(F.get_json_object(body, "$.result"), "map<string,string>")
        lists = F.map_values(F.map_filter(result, lambda name, _: name != "last"))
        rows = raw.select(*others, F.explode(lists).alias("list")).select(*others, F.explode(F.from_json("list", "array<array<string>>")).alias("k"))
        place = {"open_ms": 0, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 6}
        at = F.col("k")[0].try_cast("long") * 1000
    else:
        raise ValueError(f"unknown provider {provider}")
    prices = [positive(F.col("k")[place[c]]).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select(*others, at.alias("open_ms"), *prices, F.col("k")[place["volume"]].try_cast("double").alias("volume"))


def stream_messages(raw: DataFrame, body: str = "value") -> DataFrame:
    """Exchange push messages: aggregate trades and candles in one frame, told apart by ``kind``."""
    schema = "e string, s string, a long, p string, q string, T long, m boolean, k struct<t:long,i:string,o:string,h:string,l:string,c:string,v:string,x:boolean>"
    text = F.coalesce(F.get_json_object(F.col(body), "$.data"), F.col(body))
    m = raw.select("*", F.from_json(text, schema).alias("m"), F.get_json_object(text, "$.k.T").try_cast("long").alias("end")).where("m.e in ('aggTrade', 'kline')")
    return m.select(
        F.col("m.e").alias("kind"), F.col("m.s").alias("symbol"), F.col("m.a").alias("id"), F.col("m.p").alias("price"), F.col("m.q").alias("qty"), F.coalesce("m.T", "end").alias("ms"), F.col("m.m").alias("maker"),
        F.col("m.k.t").alias("open_ms"), F.col("m.k.i").alias("interval"), *[F.col(f"m.k.{a}").alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], F.col("m.k.x").alias("closed"),
    )


def settled(close_ms: Column, now_ms: Column, grace_ms: int) -> Column:
    """Whether a candle's close and the grace after it have passed."""
    return close_ms + grace_ms <= now_ms


def calendar_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """A week of economic events: (event_id, ts_ms, currency, impact, title); rows without a time or currency are left out."""
    rows = raw.select(F.explode(F.from_json(body, "array<struct<title:string,country:string,date:string,impact:string>>")).alias("e"))
    ts = F.unix_millis(F.try_to_timestamp("e.date"))
    impact = F.lower(F.trim("e.impact"))
    known = F.when(impact.isin("high", "medium", "low", "holiday"), impact).otherwise("unknown")
    out = rows.select(ts.alias("ts_ms"), F.upper("e.country").alias("currency"), known.alias("impact"), F.trim("e.title").alias("title")).where("ts_ms is not null and currency rlike '^[A-Z]{3}$'")
    return out.select(F.sha2(F.concat_ws("|", "ts_ms", "currency", "title"), 256).alias("event_id"), "*").dropDuplicates(["event_id"])


def labels_of(raw: DataFrame, column: str = "cells") -> DataFrame:
    """Label cells ``outcome:exit:net:cost:fund`` of pessimist and optimist, ``|`` between them and ``;`` between targets, as an array of structs."""
    def cell(text: Column) -> Column:
        part = F.split(text, ":")
        return F.struct(part[0].alias("outcome"), *[part[k].try_cast("long").alias(n) for k, n in ((1, "exit_offset"), (2, "net_ur"), (3, "cost_ur"), (4, "fund_ur"))])

    def both(text: Column) -> Column:
        side = F.split(text, r"\|")
        return F.struct(cell(side[0]).alias("pess"), cell(F.coalesce(F.get(side, F.lit(1)), side[0])).alias("opt"))

    return raw.withColumn(column, F.transform(F.split(F.col(column), ";"), both))


class AccessError(PermissionError):
    pass


def guarded(months: Sequence[str], hidden_from: str, token: str | None, expected: str | None) -> list[str]:
    """The months, if none is hidden or the token is the expected one."""
    if any(m >= hidden_from for m in months) and (expected is None or token != expected):
        raise AccessError("hidden months need a token")
    return list(months)


def read_months(spark: SparkSession, path: str, symbol: str, months: Sequence[str], **guard) -> DataFrame:
    """Bars of a symbol and some months; both are partition columns, so nothing else is listed or read."""
    allowed = guarded(months, **guard) if guard else list(months)
    return spark.read.parquet(path).where((F.col("symbol") == symbol) & F.col("month").isin(allowed))


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by symbol and month, sorted by time within files, one shuffle."""
    from ..functions.calendar import utc

    rows = bars.withColumn("month", F.date_format(utc(F.col("open_ms")), "yyyy-MM"))
    rows.repartition("symbol", "month").sortWithinPartitions("symbol", "month", "open_ms").write.mode(mode).partitionBy("symbol", "month").parquet(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: Sequence[str]) -> int:
    """Append the rows whose key the table does not hold yet; the number appended. A row that is there is never rewritten."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    new = rows.dropDuplicates(list(key))
    if there:
        new = new.join(spark.read.parquet(path).select(*key), list(key), "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n or not there:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()
