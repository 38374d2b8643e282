"""Aggregates and reports over outcomes, ledgers and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def any_of(column: str, wanted: Sequence) -> Column:
    """A report filter; an empty list means all."""
    return F.lit(True) if not wanted else F.col(column).isin(list(wanted))


def outcome_moments(rows: DataFrame, group: Sequence[str], value: str = "net", day: str = "day") -> DataFrame:
    """Per group n, sum, sum of squares, days, and the day-clustered residual sum of squares around the mean."""
    daily = rows.groupBy(*group, day).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = daily.groupBy(*group).agg(F.sum("n").alias("total_n"), F.sum("s").alias("total_s"), F.sum("q").alias("total_q"), F.count(F.lit(1)).alias("days"))
    off = F.col("s") - F.col("n") * F.col("total_s") / F.col("total_n")
    spread = daily.join(total, list(group)).groupBy(*group).agg(F.sum(off * off).alias("residual"))
    return total.join(spread, list(group))


def standard_errors(n: Column, total: Column, squares: Column, days: Column, residual: Column) -> tuple[Column, Column]:
    """(plain, day-clustered) standard error of the mean; the latter needs two days."""
    variance = (squares - total * total / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)) / n)), F.when(days > 1, F.sqrt(residual) / n)


def outcome_report(rows: DataFrame, group: Sequence[str], value: str = "net", day: str = "day") -> DataFrame:
    """Counts, sums, mean, plain and clustered errors, z."""
    m = outcome_moments(rows, group, value, day)
    n, s = F.col("total_n"), F.col("total_s")
    plain, clustered = standard_errors(n, s, F.col("total_q"), F.col("days"), F.col("residual"))
    made = m.select(*group, n.alias("n"), s.alias("total"), "days", (s / n).alias("mean"), plain.alias("se"), clustered.alias("clustered_se"))
    return made.withColumn("z", F.when(F.col("clustered_se") > 0, F.col("mean") / F.col("clustered_se")))


def paired_report(strategy: DataFrame, control: DataFrame, group: Sequence[str], value: str = "net", day: str = "day") -> DataFrame:
    """Difference of means and its error over the union of days: r_d = (s_d - n_d*S/n)/n - (c_d - m_d*C/m)/m."""
    def daily(rows: DataFrame, n: str, s: str) -> DataFrame:
        return rows.groupBy(*group, day).agg(F.count(value).alias(n), F.sum(value).alias(s))

    both = daily(strategy, "n_d", "s_d").join(daily(control, "m_d", "c_d"), [*group, day], "full_outer").na.fill(0, ["n_d", "s_d", "m_d", "c_d"])
    total = both.groupBy(*group).agg(*[F.sum(a).alias(b) for a, b in (("n_d", "n"), ("s_d", "s"), ("m_d", "m"), ("c_d", "c"))], F.count(F.lit(1)).alias("days")).where("n > 0 and m > 0")
    r = (F.col("s_d") - F.col("n_d") * F.col("s") / F.col("n")) / F.col("n") - (F.col("c_d") - F.col("m_d") * F.col("c") / F.col("m")) / F.col("m")
    spread = both.join(total, list(group)).groupBy(*group).agg(F.sum(r * r).alias("q"))
    rows = total.join(spread, list(group))
    return rows.select(*group, "n", "m", "days", (F.col("s") / F.col("n") - F.col("c") / F.col("m")).alias("difference"), F.sqrt("q").alias("se"))


def drawdown(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Greatest fall of the running sum below its peak (0 at the start) and the number of rows below it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__sum", F.sum(value).over(w))
    run = run.withColumn("__fall", F.greatest(F.max("__sum").over(w), F.lit(0)) - F.col("__sum"))
    return run.groupBy(key).agg(F.max("__fall").alias("drawdown"), F.count_if(F.col("__fall") > 0).alias("below"))


def daily_series(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Sums by day for every day from a key's first to its last, zero where there is none; ``day`` is a date."""
    daily = rows.groupBy(key, day).agg(F.sum(value).alias(value))
    ends = daily.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select(key, F.explode(F.sequence("a", "b")).alias(day))
    return days.join(daily, [key, day], "left").select(key, day, F.coalesce(value, F.lit(0)).alias(value))


def trade_metrics(rows: DataFrame, group: Sequence[str], value: str = "net") -> DataFrame:
    """Hit rate, payoff and profit factor."""
    v = F.col(value)
    won, lost = F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))
    out = rows.groupBy(*group).agg(F.count(v).alias("n"), F.count_if(v > 0).alias("wins"), won.alias("won"), lost.alias("lost"), F.avg(F.when(v > 0, v)).alias("mean_win"), (-F.avg(F.when(v < 0, v))).alias("mean_loss"))
    return out.select(*group, "n", "wins", (F.col("wins") / F.col("n")).alias("hit_rate"), (F.col("mean_win") / F.col("mean_loss")).alias("payoff"), (F.col("won") / F.col("lost")).alias("profit_factor"))


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = wins / n
    middle, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / scale, (middle + half) / scale


def state_runs(rows: DataFrame, key: str, order: Sequence[str], label: str) -> DataFrame:
    """Runs of equal labels: number, mean and longest length per key and label."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__new", F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    runs = marked.groupBy(key, label, "__run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key, label).agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean_length"), F.max("n").alias("longest"))


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def page(rows: DataFrame, before: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Keyset pagination: the next ``n`` rows past the cursor."""
    return rows.where(before).orderBy(*order).limit(n)


def last_balance(ledger: DataFrame, account: str, ms: str, seq: str, balance: str, bucket_ms: int) -> DataFrame:
    """The last balance of each account and time bucket."""
    bucket = (F.col(ms) - F.pmod(ms, F.lit(bucket_ms))).alias("bucket_ms")
    return ledger.groupBy(account, bucket).agg(F.max_by(balance, F.struct(ms, seq)).alias("balance"))


def z_statistics(rows: DataFrame, group: Sequence[str], z: str) -> DataFrame:
    """Spread, mean size and shares beyond 1, 2 and 3."""
    a = F.abs(F.col(z))
    return rows.groupBy(*group).agg(F.count(z).alias("n"), F.stddev_samp(z).alias("sd"), F.avg(a).alias("mean_abs"), *[(F.count_if(a > k) / F.count(z)).alias(f"beyond_{k}") for k in (1, 2, 3)])


def holm(rows: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Holm's adjusted p: running maximum of (m - k + 1) * p, at most 1."""
    w = Window.partitionBy(*family).orderBy(p)
    ranked = rows.withColumn("__k", F.row_number().over(w)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    scaled = (F.col("__m") - F.col("__k") + 1) * F.col(p)
    adjusted = F.least(F.lit(1.0), F.max(scaled).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("holm", adjusted).drop("__k", "__m")


def benjamini_hochberg(rows: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """q-values: running minimum, from the largest p, of m * p / k, at most 1."""
    w = Window.partitionBy(*family).orderBy(p)
    ranked = rows.withColumn("__k", F.row_number().over(w)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    scaled = F.col("__m") * F.col(p) / F.col("__k")
    q = F.least(F.lit(1.0), F.min(scaled).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return ranked.withColumn("q", q).drop("__k", "__m")


def stratified_sample(rows: DataFrame, stratum: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows per stratum, those with the smallest sha256 of seed and key."""
    draw = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return newest(rows, stratum, [draw, F.col(key)], n)


def evenly_spaced(rows: DataFrame, key: Sequence[str], order: str, n: int) -> DataFrame:
    """One row, the first, of each of ``n`` equal parts of a key's rows."""
    part = F.ntile(n).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("part", part).withColumn("__k", F.row_number().over(Window.partitionBy(*key, "part").orderBy(order))).where("__k = 1").drop("__k")


def weighted_quantile(rows: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the cumulated weight reaches share ``q``."""
    w = Window.partitionBy(group).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__w", F.sum(weight).over(w)).withColumn("__t", F.sum(weight).over(Window.partitionBy(group)))
    return run.where(F.col("__w") >= q * F.col("__t")).groupBy(group).agg(F.min(value).alias(value))


def dose_response(rows: DataFrame, by: str, value: str, buckets: int = 5, key: str = "id") -> DataFrame:
    """Mean of ``value`` per equal-sized bucket of ``by``, ties dealt by the numeric ``key``."""
    dealt = ranks.ranked(rows, by, key).withColumn("bucket", ranks.equal_parts(F.col("rank"), F.col("n"), buckets))
    return dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lowest"), F.max(by).alias("highest"), F.avg(value).alias("mean"))


def stratified_difference(rows: DataFrame, stratum: Sequence[str], member: str, value: str) -> DataFrame:
    """Member minus control means per stratum, weighted by members; strata without either are left out."""
    m = F.col(member)
    cells = rows.groupBy(*stratum).agg(F.count_if(m).alias("n"), F.count_if(~m).alias("controls"), F.avg(F.when(m, F.col(value))).alias("a"), F.avg(F.when(~m, F.col(value))).alias("b"))
    cells = cells.where("n > 0 and controls > 0")
    return cells.agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("members"), (F.sum((F.col("a") - F.col("b")) * F.col("n")) / F.sum("n")).alias("difference"))


def conflicts(stored: DataFrame, offered: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Offered rows whose key is stored with other values, and the names of the values that differ."""
    a = stored.select(*key, F.struct(*values).alias("__a"))
    met = a.join(offered.select(*key, F.struct(*values).alias("__b")), list(key))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}")), F.lit(v)) for v in values]))
    return met.withColumn("fields", differing).where(F.size("fields") > 0).select(*key, "fields")


def day_balanced_terciles(rows: DataFrame, day: str, value: str) -> DataFrame:
    """The values at which cumulated mass reaches one and two thirds when each day has mass 1, spread over its rows."""
    share = rows.where(F.col(value).isNotNull()).withColumn("__w", 1 / F.count(F.lit(1)).over(Window.partitionBy(day)))
    cells = share.groupBy(value).agg(F.sum("__w").alias("__w"))
    run = ranks.running_sum(cells, [], value, F.col("__w"), name="__c", total="__t")
    return run.agg(*[F.min(F.when(F.col("__c") * 3 >= k * F.col("__t") - 1e-9, F.col(value))).alias(f"tercile_{k}") for k in (1, 2)])
