"""First-write-wins ingest, monotonic state and event windows for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..sources.archives import append_new


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def first_write_wins(table: str, conflicts: str, key: Sequence[str], values: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new keys are appended, offers that differ from what is stored are logged, nothing is rewritten.

    A batch that runs twice appends nothing the second time, as its keys are there, and its conflicts are logged under its number once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            first = reports.newest(batch, key, [F.struct(*values)]).drop("rank")
            append_new(spark, first, table, key)
            stored = spark.read.parquet(table).join(batch.select(*key).distinct(), list(key), "left_semi")
            found = reports.conflicts(stored, batch, key, values).distinct().withColumn("batch", F.lit(number).cast("long"))
            append_new(spark, found, conflicts, [*key, "batch"])
        finally:
            batch.unpersist()

    return run


def latest_state(rows: DataFrame, key: Sequence[str], boundary: str) -> DataFrame:
    """Per key the row of the newest boundary; an older one never replaces it."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), boundary).alias("__s"))
    return best.select(*key, "__s.*")


def reconciled(conflicts: DataFrame, price_tolerance: float = 0.002, volume_tolerance: float = 0.02) -> DataFrame:
    """``revise``: whether an offer differs from what is stored within the tolerances; (stored, offered) are structs of open, high, low, close, volume."""
    def near(name: str, tolerance: float) -> Column:
        a, b = F.col(f"stored.{name}"), F.col(f"offered.{name}")
        return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))

    prices = [near(n, price_tolerance) for n in ("open", "high", "low", "close")]
    every = near("volume", volume_tolerance)
    for p in prices:
        every = every & p
    return conflicts.withColumn("revise", F.coalesce(every, F.lit(False)))


def sliding(rows: DataFrame, ts: str, windows: Sequence[str] = ("1 minute", "5 minutes", "15 minutes"), slide: str = "5 seconds", grace: str = "2 seconds") -> list[DataFrame]:
    """Per window length a watermarked aggregate sliding by ``slide``: first and last price and notional per symbol."""
    marked = rows.withWatermark(ts, grace)
    return [
        marked.groupBy(F.window(ts, w, slide), "symbol").agg(F.min_by("price", F.struct(ts, "id")).alias("first"), F.max_by("price", F.struct(ts, "id")).alias("last"), F.sum(F.col("price") * F.col("qty")).alias("notional"))
        for w in windows
    ]


def unique_events(stream: DataFrame, key: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """A stream without exact repeats that come within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))
