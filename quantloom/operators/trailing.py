"""Long trailing frames: order statistics by one sorted list that moves along a span of a series, sums by what enters and leaves. No frame is held per row."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar
from .context import SPAN, dealt


def middle(held: Sequence[float]) -> float:
    n = len(held)
    return held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2


def kth_deviation(held: Sequence[float], mid: float, k: int) -> float:
    """The k-th (from 0) smallest distance to ``mid`` in a sorted list, by bisection of how many of them lie below ``mid``."""
    p = bisect_left(held, mid)
    low, high = max(0, k + 1 - (len(held) - p)), min(k + 1, p)
    while low < high:
        i = (low + high) // 2
        if mid - held[p - 1 - i] < held[p + k - i] - mid:
            low = i + 1
        else:
            high = i
    below = mid - held[p - low] if low else -math.inf
    above = held[p + k - low] - mid if low <= k else -math.inf
    return max(below, above)


def median_deviation(held: Sequence[float], mid: float) -> float:
    n = len(held)
    top = kth_deviation(held, mid, n // 2)
    return top if n % 2 else (kth_deviation(held, mid, n // 2 - 1) + top) / 2


def scores(times: Sequence[int], values: Sequence[float | None], reach: int, least: int, scale: float) -> list[float | None]:
    """(x - median) / (scale * MAD) against the values in [t - reach, t); times are sorted. Absent and NaN values are neither scored nor held."""
    held: list[float] = []
    known = [v if v is not None and v == v else None for v in values]
    old = new = 0
    out: list[float | None] = []
    for t, x in zip(times, known, strict=True):
        while times[new] < t:
            if known[new] is not None:
                insort(held, known[new])
            new += 1
        while old < new and times[old] < t - reach:
            if known[old] is not None:
                del held[bisect_left(held, known[old])]
            old += 1
        z = None
        if x is not None and held and len(held) >= least:
            mid = middle(held)
            spread = median_deviation(held, mid)
            z = (x - mid) / (scale * spread) if spread > 0 else None
        out.append(z)
    return out


def robust_z(frame: DataFrame, x: str, days: int, least: int, scale: float = 1.4826, name: str = "z", key: str = "symbol", at: str = "open_ms", span: int = SPAN) -> DataFrame:
    """``name``: the robust score of ``x`` against the strictly earlier rows of the last ``days`` days; null with fewer than ``least`` or no spread.

    A task holds one span of a key and the ``days`` before it. Rows without a time are left out.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.DoubleType())])

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        z = scores(table["__at"].to_pylist(), table["__x"].to_pylist(), days * calendar.DAY, least, scale)
        home = table["__home"]
        kept = table.select(frame_columns).append_column(name, pa.array(z, pa.float64()))
        return kept.filter(pc.fill_null(home, False))

    frame_columns = frame.columns
    rows = frame.select("*", F.col(at).cast("long").alias("__at"), F.col(x).cast("double").alias("__x"))
    return dealt(rows, "__at", span, behind=days * calendar.DAY).groupBy(key, "__span").applyInArrow(score, schema)


def moving_sums(rows: DataFrame, key: str, at: str, values: Mapping[str, Column], behind: int, ahead: int = 0, span: int = calendar.DAY) -> DataFrame:
    """Rows with the sums of integer ``values`` over their key's rows from ``behind`` before to ``ahead`` after their time, zero of none.

    Rows of one time are summed first. A time's sums enter a running sum ``ahead`` before it and leave it once
    ``behind`` is past, so that the work grows with the rows and not with the frames. Spans of time are summed by
    themselves and carried, so that a task sorts a span of a key. Sums are exact, in decimals of 38 digits. A null
    key is a key; rows without a time are in each other's frames, as in a window.
    """
    names = list(values)
    t = F.col("__t")
    points = rows.groupBy(F.col(key).alias("__k"), F.col(at).alias("__t")).agg(*[F.coalesce(F.sum(_wide(v)), _wide(F.lit(0))).alias(n) for n, v in values.items()])

    def event(when: Column, sign: Column, asks: bool) -> Column:
        return F.struct(when.alias("__at"), F.lit(asks).alias("__asks"), *[_wide(sign * F.col(n)).alias(n) for n in names])

    events = [event(t - ahead, F.lit(1), ahead == 0), event(t + behind + 1, F.when(t.isNull(), 0).otherwise(-1), False)]
    events += [] if ahead == 0 else [event(t, F.lit(0), True)]
    stream = points.select("__k", F.inline(F.array(*events))).withColumn("__span", F.floor(F.col("__at") / span))
    sums = stream.where("__span is not null").groupBy("__k", "__span").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("__k").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("__k").alias("__bk"), F.col("__span").alias("__bs"), *[F.sum(n).over(earlier).alias(f"__b{i}") for i, n in enumerate(names)])
    until = Window.partitionBy("__k", "__span").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    run = stream.select("__k", "__span", "__at", "__asks", *[F.sum(n).over(until).alias(f"__v{i}") for i, n in enumerate(names)]).where("__asks")
    met = run.join(carried, F.col("__k").eqNullSafe(F.col("__bk")) & (F.col("__span") == F.col("__bs")), "left")
    found = met.select("__k", "__at", *[(F.col(f"__v{i}") + F.coalesce(f"__b{i}", _wide(F.lit(0)))).alias(n) for i, n in enumerate(names)])
    return rows.join(found, F.col(key).eqNullSafe(F.col("__k")) & F.col(at).eqNullSafe(F.col("__at"))).drop("__k", "__at")


def moving_mean(rows: DataFrame, key: str, at: str, x: str, behind: int, ahead: int = 0) -> DataFrame:
    """Rows with the ``mean`` of an integer ``x`` over their frame, null without any, and ``n``, how many rows the frame has."""
    sums = {"__sum": F.col(x), "__known": F.col(x).isNotNull().cast("int"), "n": F.lit(1)}
    found = moving_sums(rows, key, at, sums, behind, ahead)
    mean = F.when(F.col("__known") > 0, F.col("__sum").cast("double") / F.nullif(F.col("__known"), F.lit(0)).cast("double"))
    return found.select(*rows.columns, mean.alias("mean"), F.col("n").cast("long").alias("n"))


def _wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")
