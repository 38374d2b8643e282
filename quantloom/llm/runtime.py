"""Session helpers: the shared folder, written intermediate tables, table input."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Where the session names none, a local session, whose driver and executors are one process, has a
    folder of its application under the local temporary directory; any other must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"quantloom-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread.

    Cuts the lineage: what reads the result survives the loss of any executor, since the
    files are not an executor's own.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, by: str, values: tuple[int, ...]) -> list[DataFrame]:
    """``written``, with a folder and a table for each of ``values`` of the column ``by``, which has no others."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(by).parquet(path)
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for value in values:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        folder.getFileSystem(conf).mkdirs(folder)  # there may be no rows of it
        out.append(spark.read.schema(df.schema).option("basePath", path).parquet(folder.toString()).select(df.columns))
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` returned; it must not be read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of shuffles that no table needs any more, at once rather than when the driver's heap fills.

    A shuffle's files go when the driver's JVM finds its plan unreachable; what still is in use stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches to Python are bounded by rows and by bytes, as texts can be very long.
BATCH_ROWS, BATCH_BYTES = "2048", "8m"


def bounded_batches(spark: SparkSession) -> None:
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def tidy(function):
    """An Arrow function whose worker gives its freed memory back when a task ends; workers are reused."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run
