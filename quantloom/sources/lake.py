"""Files of whole months: written once, byte-stable, and read back strictly.

Readers tell faults by raising with the place of the first one; nothing is repaired or filled.
"""

from __future__ import annotations

import csv
import io
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.exact import parse_scaled, positive

#: Flag bits of a bar, and the columns of funding and daily files.
PREMIUM_MISSING = 1 << 5
FUNDING_COLUMNS = "calc_time_ms long, funding_interval_hours int, last_funding_rate string, last_funding_rate_published string"
INT64_MAX = 2**63 - 1
METRIC_PERIOD_MS = 300_000


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/quantloom-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def month_of(ms: Column) -> Column:
    return F.date_format(calendar.utc(ms), "yyyy-MM")


def month_start(month: Column) -> Column:
    """Milliseconds of a month's first instant, from ``yyyy-MM``."""
    return F.unix_date(F.to_date(F.concat(month, F.lit("-01")))).cast("long") * calendar.DAY


def month_end(month: Column) -> Column:
    return F.unix_date(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1)).cast("long") * calendar.DAY


def write_months(rows: DataFrame, path: str, order: str, columns: Sequence[str]) -> None:
    """One gzip CSV file per (symbol, month) with a header, sorted by ``order``; equal rows give equal bytes.

    One shuffle on the partition columns; a file is one month of one symbol, which bounds a task.
    """
    kept = rows.select("symbol", "month", *columns)
    sorted_ = kept.repartition("symbol", "month").sortWithinPartitions("symbol", "month", order)
    sorted_.write.partitionBy("symbol", "month").option("header", True).option("compression", "gzip").option("emptyValue", "").option("nullValue", "").csv(path)


def read_csv_months(spark: SparkSession, path: str, schema: str, months: Sequence[str] | None = None) -> DataFrame:
    """Rows of such files; a header that differs from ``schema`` or a malformed row raises, other months aren't opened."""
    reader = spark.read.schema(f"{schema}, symbol string, month string").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    rows = reader.csv(path)
    return rows if months is None else rows.where(F.col("month").isin(list(months)))


def _demand(holds: Column, value: Column, *message) -> Column:
    """``value``, or an error that names the place where the demand does not hold."""
    return F.when(holds, value).otherwise(F.raise_error(F.concat_ws(" ", *[m if isinstance(m, Column) else F.lit(m) for m in message])))


def complete_months(rows: DataFrame, minutes: int, at: str = "open_time_ms") -> DataFrame:
    """The rows, if each month holds one row per step from its first to its last instant; else reading them raises.

    A window of one (symbol, month) sees each row's neighbours, so gaps, repeats and cut ends are found in one sort.
    """
    w = Window.partitionBy("symbol", "month").orderBy(at)
    step, t = minutes * calendar.MINUTE, F.col(at)
    before = F.coalesce(F.lag(t).over(w), month_start(F.col("month")) - step)
    after = F.coalesce(F.lead(t).over(w), month_end(F.col("month")))
    checked = rows.withColumn("__whole", (t == before + step) & (after == t + step))
    return checked.withColumn(at, _demand(F.coalesce("__whole", F.lit(False)), t, "gap or repeated step at", F.col("symbol"), t.cast("string"))).drop("__whole")


def _price(text: Column) -> Column:
    """A scaled price; an absent one is null, any other text that is no positive decimal raises."""
    return F.when(text.isNotNull(), _demand(positive(text).isNotNull(), parse_scaled(text).cast("long"), "bad price", text))


def bars_month(raw: DataFrame, minutes: int) -> DataFrame:
    """Bars of complete months with exact scaled prices; missing prices stay missing."""
    whole = complete_months(raw, minutes)
    prices = [_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return whole.select("symbol", F.col("open_time_ms").alias("open_ms"), *prices, parse_scaled(F.col("volume")).cast("long").alias("volume"), "trades", "flags")


def premium_month(raw: DataFrame, minutes: int) -> DataFrame:
    """Premium and index close of complete months; the flag and the value must agree. No other column is parsed."""
    whole = complete_months(raw, minutes)
    missing = F.col("flags").bitwiseAND(PREMIUM_MISSING) != 0
    agreed = _demand(missing == F.col("premium_close").isNull(), parse_scaled(F.col("premium_close")).cast("long"), "premium and flag disagree at", F.col("open_time_ms").cast("string"))
    return whole.select("symbol", F.col("open_time_ms").alias("open_ms"), agreed.alias("premium_close"), _price(F.col("index_close")).alias("index_close"))


def funding_months(raw: DataFrame) -> DataFrame:
    """Settlements in order within their months, intervals positive; a month without any is allowed."""
    w = Window.partitionBy("symbol", "month").orderBy("calc_time_ms")
    t = F.col("calc_time_ms")
    within = (t >= month_start(F.col("month"))) & (t < month_end(F.col("month"))) & (F.col("funding_interval_hours") > 0) & F.coalesce(F.lag(t).over(w) < t, F.lit(True))
    rows = raw.withColumn("__fits", within)
    at = _demand(F.coalesce("__fits", F.lit(False)), t, "settlement out of place:", F.col("symbol"), t.cast("string"))
    return rows.select("symbol", at.alias("calc_time_ms"), F.col("funding_interval_hours").alias("interval_hours"), parse_scaled(F.col("last_funding_rate")).cast("long").alias("rate"))


def write_zips(rows: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], path: str, header: bool = True) -> DataFrame:
    """One zip with one CSV member per key, named by it; gives (name, rows). A key's rows are one archive and so one task.

    Run again after a lost executor, a task writes the same bytes under the same name.
    """
    def write(frame: pd.DataFrame) -> pd.DataFrame:
        name = "-".join(str(frame[k].iloc[0]) for k in key)
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        if header:
            out.writerow(columns)
        out.writerows(frame.sort_values(order)[list(columns)].itertuples(index=False, name=None))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(zipfile.ZipInfo(f"{name}.csv"), text.getvalue())  # a fixed date
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(posixpath.join(folder, f"{name}.zip"), compression=None) as f:
            f.write(packed.getvalue())
        return pd.DataFrame({"name": [name], "rows": [len(frame)]})

    return rows.groupBy(*key).applyInPandas(write, "name string, rows long")


def daily_klines(raw: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """Days of a month range from daily candles, ``symbol`` from the file's name; volumes beyond 64 bits are missing."""
    symbol = F.regexp_extract("file", r"([^/]+)-\d{4}-\d{2}\.zip$", 1)
    t = F.col("open_time_ms")
    rows = raw.where((t >= month_start(F.lit(first_month))) & (t < month_end(F.lit(last_month))))
    at = _demand(t % calendar.DAY == 0, t, "no start of a day:", t.cast("string"))
    volume = parse_scaled(F.col("volume"))
    prices = [parse_scaled(F.col(c)).cast("long").alias(c) for c in ("open", "high", "low", "close")]
    return rows.select(symbol.alias("symbol"), at.alias("open_ms"), *prices, F.when(F.abs(volume) <= INT64_MAX, volume.cast("long")).alias("volume"), "trades")


def metrics_grid(metrics: DataFrame, first_month: str, last_month: str, months: Sequence[str], column: str) -> DataFrame:
    """A metric on the dense five-minute grid of a month range, at the time it may be used; only ``months`` are read, the rest is null."""
    ends = [month_start(F.lit(first_month)) + METRIC_PERIOD_MS, month_end(F.lit(last_month)) + METRIC_PERIOD_MS]
    read = metrics.where(month_of(F.col("create_time_ms")).isin(list(months)))
    at = _demand(F.col("create_time_ms") % METRIC_PERIOD_MS == 0, F.col("usable_from_ms"), "off the grid:", F.col("create_time_ms").cast("string"))
    read = read.select("symbol", at.alias("at_ms"), column)
    grid = metrics.select("symbol").distinct().select("symbol", F.explode(F.sequence(*ends, F.lit(METRIC_PERIOD_MS).cast("long"))).alias("at_ms"))
    return grid.join(read, ["symbol", "at_ms"], "left")
