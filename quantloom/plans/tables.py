"""Market views of the driver's tables, as DataFrames and as SQL to start a query with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import bars

HOUR, DAY = calendar.HOUR, calendar.DAY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: the type is the symbol, the value in cents the price, ``props.k`` the quantity and its parity the maker flag."""
    qty = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), calendar.epoch_ms(F.col("ts")).alias("ms"),
        F.round(F.col("value") * 100).cast("long").alias("price"), qty.alias("qty"), (qty % 2 == 1).alias("maker"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.minute_bars(trades(spark, sf_dir), 60)


def four_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.minute_bars(trades(spark, sf_dir), 240)


TRADES = """trades as (
  select event_type as symbol, event_id as id, (epoch_us(ts) // 1000) as ms, cast(round(value * 100) as bigint) as price,
         cast(json_extract_string(props, '$.k') as bigint) as qty,
         cast(json_extract_string(props, '$.k') as bigint) % 2 = 1 as maker
  from events)"""


def bars_sql(name: str, minutes: int) -> str:
    step = minutes * calendar.MINUTE
    return f"""{name} as (
  select symbol, ms - ms % {step} as open_ms, arg_min(price, id) as open, max(price) as high, min(price) as low,
         arg_max(price, id) as close, cast(sum(qty) as bigint) as volume,
         cast(sum(case when not maker then qty else 0 end) as bigint) as taker_volume,
         cast(sum(price * qty) as bigint) as quote, count(*) as trades, min(id) as first_id, max(id) as last_id
  from trades group by 1, 2)"""


HOURLY = "with " + TRADES + ",\n" + bars_sql("bars", 60)
FOUR_HOURLY = "with " + TRADES + ",\n" + bars_sql("bars", 240)
DENSE = """ends as (select symbol, min(open_ms) as a, max(open_ms) as b from bars group by symbol),
spine as (select symbol, unnest(range(a, b + 3600000, 3600000)) as open_ms from ends),
dense as (
  select s.symbol, s.open_ms, b.open, b.high, b.low, b.close, b.volume, b.taker_volume,
         case when b.close is null then 1 else 0 end as flags
  from spine s left join bars b on b.symbol = s.symbol and b.open_ms = s.open_ms)"""
