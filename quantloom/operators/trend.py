"""Daily trend portfolios: signals, sizing, costs, equity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling


def tsmom(close: Column, lookback: int) -> Column:
    """Sign of the log return over ``lookback`` rows."""
    return F.signum(F.ln(close / F.lag(close, lookback).over(rolling.by_symbol())))


def ma_score(close: Column, windows: Sequence[int]) -> Column:
    """Mean of the signs of close against several averages; null until the longest is known."""
    parts = [F.signum(close - rolling.rolling_mean(close, n)) for n in windows]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def target_weight(signal: Column, target: float, sigma: Column, most: float = 2.0) -> Column:
    """clip(signal * target / sigma, -most, most)."""
    return F.when(sigma > 0, F.greatest(F.lit(-most), F.least(F.lit(most), signal * target / sigma)))


def net_returns(rows: DataFrame, cost_bp: float) -> DataFrame:
    """``net``: yesterday's weight times the return, less costs on the change of weight and funding."""
    w = rolling.by_symbol()
    held, before = F.lag("weight").over(w), F.lag("weight", 2).over(w)
    net = held * F.col("ret") - cost_bp / 10_000 * F.abs(held - F.coalesce(before, F.lit(0.0))) - held * F.col("funding")
    return rows.withColumn("net", net)


def portfolio(rows: DataFrame, day: str, value: str) -> DataFrame:
    """Equal-weight mean over the symbols that have a value, in whole parts per million, and their number."""
    return rows.where(F.col(value).isNotNull()).groupBy(day).agg(F.round(F.avg(value) * 1_000_000).cast("long").alias("ppm"), F.count(F.lit(1)).alias("active"))


def equity(rows: DataFrame, day: str, ppm: str = "ppm") -> DataFrame:
    """Compounded equity and its drawdown, over one short daily series."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col(ppm) / 1_000_000)).over(w)))
    return run.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


def without_best_month(rows: DataFrame, month: str, value: str) -> DataFrame:
    """The sum with and without the month of the largest sum."""
    months = rows.groupBy(month).agg(F.sum(value).alias("s"))
    return months.agg(F.sum("s").alias("total"), (F.sum("s") - F.max("s")).alias("without_best"), F.count(F.lit(1)).alias("months"))


def stream_stats(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurtosis"), F.min(v).alias("worst"), F.max(v).alias("best"))


def shifted(rows: DataFrame, key: str, order: str, value: str, offset: int) -> DataFrame:
    """``value`` of ``offset`` rows later, around the end: the circular shift of a placebo."""
    w = Window.partitionBy(key)
    marked = rows.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    other = marked.select(key, F.pmod(F.col("__k") - offset, F.col("__n")).alias("__k"), F.col(value).alias("shifted"))
    return marked.join(other, [key, "__k"]).drop("__k", "__n")
