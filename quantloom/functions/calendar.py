"""UTC calendar arithmetic on epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
#: 1970-01-05, the first Monday of the epoch.
MONDAY = 4 * DAY
#: Days of Bitcoin's halvings.
HALVINGS = ("2012-11-28", "2016-07-09", "2020-05-11", "2024-04-20")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def bucket(ms: Column, minutes: int) -> Column:
    """Open of the left-closed bucket; weeks (10080 minutes) open on Monday."""
    step = minutes * MINUTE
    anchor = MONDAY if minutes == 10_080 else 0
    return ms - F.pmod(ms - anchor, F.lit(step))


def right_closed(ms: Column, step_ms: int = 5_000) -> Column:
    """The boundary at or after ``ms``: buckets hold (boundary - step, boundary]."""
    return ms + F.pmod(-ms, F.lit(step_ms))


def day(ms: Column) -> Column:
    return bucket(ms, 1440)


def week_start(ms: Column) -> Column:
    return bucket(ms, 10_080)


def utc(ms: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def month_start(ms: Column) -> Column:
    return epoch_ms(F.date_trunc("month", utc(ms)).cast("timestamp_ntz"))


def hour(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY)) / HOUR).cast("int")


def weekday(ms: Column) -> Column:
    """0 on Monday."""
    return F.pmod(F.floor((ms - MONDAY) / DAY), F.lit(7)).cast("int")


def session(ms: Column) -> Column:
    """asia 0-8, europe 8-13, overlap 13-17, us 17-22, late 22-24 (UTC hours)."""
    h = hour(ms)
    return F.when(h < 8, "asia").when(h < 13, "europe").when(h < 17, "overlap").when(h < 22, "us").otherwise("late")


def halving_months(day_: Column) -> Column:
    """Whole months since the last halving on or before a date; null before the first."""
    out = F.lit(None).cast("int")
    for start in HALVINGS:
        out = F.when(day_ >= F.lit(start).cast("date"), F.floor(F.months_between(day_, F.lit(start).cast("date"))).cast("int")).otherwise(out)
    return out
