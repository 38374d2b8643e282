"""Signals, checks, evidence joins and resampling as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact

# -- checks and texts


def candle_reasons(open_ms: Column, open_: Column, high: Column, low: Column, close: Column, volume: Column, minutes: int) -> Column:
    """What is wrong with a candle: its interval, a price, the volume, the range; empty if nothing is."""
    prices = (open_, high, low, close)
    bad = {
        "INTERVAL": open_ms % (minutes * 60_000) != 0, "PRICE": ~F.coalesce(F.least(*prices) > 0, F.lit(False)) | F.greatest(*[p.isNull() for p in prices]),
        "VOLUME": ~F.coalesce(volume >= 0, F.lit(False)), "RANGE": ~F.coalesce(open_.between(low, high) & close.between(low, high), F.lit(False)),
    }
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()])), ",")


def csv_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where it must be; null is empty."""
    text = F.coalesce(text, F.lit(""))
    clear = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(clear.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(clear, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(clear)


def comparison(n: Column, days: Column, control_n: Column, control_days: Column, z: Column, critical: float, least: int, least_days: int) -> Column:
    """What may be said of a strategy against its control."""
    few = (n < least) | (days < least_days) | (F.coalesce(control_n, F.lit(least)) < least) | (F.coalesce(control_days, F.lit(least_days)) < least_days)
    return F.when(few, "too_few").when(control_n.isNull(), "no_baseline").when(z.isNull(), "no_spread").when(F.abs(z) < critical, "no_difference").when(z < 0, "worse").otherwise("better")


def experiment_verdict(powered: Column, one: Column, two: Column, optimistic: Column, ambiguous: Column, unmeasured: Column, n: Column, rejected: Column, lower: Column, alpha: float = 0.05) -> Column:
    """NOT_ENOUGH_EVIDENCE, then FRAGILE, then PASS, else FAIL: the first that holds."""
    fragile = ((one > 0) & (two <= 0)) | (one * optimistic < 0) | ((n > 0) & (10 * ambiguous > n)) | ((n > 0) & (unmeasured > alpha * n))
    return F.when(~powered, "NOT_ENOUGH_EVIDENCE").when(fragile, "FRAGILE").when(rejected & (lower > 0) & (two > 0), "PASS").otherwise("FAIL")


def feed_health(now: Column, newest_open: Column, is_open: Column, live_ms: int, stale_ms: int) -> Column:
    """Of a feed of minute bars: closed market first, then by the lag since the newest bar's end."""
    lag = now - newest_open - 60_000
    return F.when(~is_open, "MARKET_CLOSED").when(newest_open.isNull() | (lag > stale_ms), "STALE").when(lag > live_ms, "RECOVERING").otherwise("LIVE")


def coverage_reason(last_ok: Column, covered_to: Column, now: Column, needed_to: Column, most_age_ms: int) -> Column:
    """Why a calendar may not be used, null if it may; what is not known counts against it."""
    return F.when(last_ok.isNull(), "calendar_never_fetched").when(now - last_ok > most_age_ms, "calendar_stale").when(covered_to.isNull() | (covered_to < needed_to), "calendar_horizon_short")


def worst_case_end(signal_ms: Column, horizon_min: Column, multiple: int = 4) -> Column:
    """The latest time that a label of a signal may look at."""
    return signal_ms + horizon_min * multiple * 60_000


def placebo_words(seed: int, symbol: Column, strategy: str, ms: Column) -> tuple[Column, Column]:
    """Two words of a counter stream named by symbol and strategy, two per minute."""
    first = F.floor(ms / 60_000).cast("long") * 2
    words = exact.counter_words(F.lit(seed), F.concat(F.lit("forward-placebo:"), symbol, F.lit(":" + strategy)), F.floor(first / 4).cast("long"))
    return tuple(F.get(words, ((first + k) % 4).cast("int")) for k in range(2))


def supremum_cdf(x: Column, terms: int = 60) -> Column:
    """P(sup |W| over [0, 1] <= x) of a Brownian motion, by its alternating series."""
    odd = F.transform(F.sequence(F.lit(0), F.lit(terms - 1)), lambda n: F.when(n % 2 == 0, 1.0).otherwise(-1.0) * F.exp(-((2 * n + 1) * (2 * n + 1)).cast("double") * F.pi() * F.pi() / (8 * x * x)) / (2 * n + 1))
    total = F.aggregate(odd, F.lit(0.0), lambda a, b: a + b)
    return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 4 / F.pi() * total)))


# -- features


def zero_crossings(value: Column, before: Column) -> Column:
    """1 where the value rises above zero, -1 where it falls below, 0 elsewhere and where one is missing."""
    return F.when((before <= 0) & (value > 0), 1).when((before >= 0) & (value < 0), -1).otherwise(0)


def flushes(ret: Column, sigma: Column, interest_z: Column, sigmas: float = 3.0, z: float = -3.0) -> Column:
    """-1 or 1 for a move of ``sigmas`` while open interest collapses, 0 otherwise, null without its inputs."""
    fell = interest_z <= z
    return F.when(sigma.isNull() | (sigma == 0) | interest_z.isNull(), F.lit(None)).when(fell & (ret <= -sigmas * sigma), -1).when(fell & (ret >= sigmas * sigma), 1).otherwise(0)


def geometry(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Shares of a candle's range: body, upper and lower wick, where it closed; null without a range."""
    span = F.when(high > low, high - low)
    return {"body": F.abs(close - open_) / span, "upper": (high - F.greatest(open_, close)) / span, "lower": (F.least(open_, close) - low) / span, "location": (close - low) / span}


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) by the rules of IEEE doubles: infinite where one of the two is zero, NaN where both are or signs differ; null only without a or b."""
    ratio = F.ln(a / F.nullif(b, F.lit(0)))
    known = F.when(((a > 0) & (b > 0)) | ((a < 0) & (b < 0)), ratio).when((a == 0) & (b != 0), float("-inf")).when((a > 0) & (b == 0), float("inf")).otherwise(float("nan"))
    return F.when(a.isNotNull() & b.isNotNull(), known)


def follow_through(rows: DataFrame, key: str, order: str, direction: Column, h: int) -> DataFrame:
    """Over the ``h`` rows after each: return, best and worst excursion on the direction's side in basis points; null if rows are missing.

    Prices of zero count: an excursion to or from one is infinite.
    """
    w = Window.partitionBy(key).orderBy(order)
    ahead = w.rowsBetween(1, h)
    full = F.count(F.lit(1)).over(ahead) == h
    close, high, low = F.last("close").over(ahead), F.max("high").over(ahead), F.min("low").over(ahead)
    up, down = log_ratio(high, F.col("close")), log_ratio(F.col("close"), low)
    out = {"ret_bp": direction * log_ratio(close, F.col("close")), "mfe_bp": F.when(direction > 0, up).otherwise(down), "mae_bp": F.when(direction > 0, down).otherwise(up)}
    return rows.select("*", *[F.when(full & (direction != 0), 1e4 * v).alias(n) for n, v in out.items()])


def last_run(rows: DataFrame, key: str, order: str, step_ms: int) -> DataFrame:
    """The rows of each key's last stretch without a gap."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    gap = F.coalesce((F.lag(order).over(w) - F.col(order) != step_ms).cast("int"), F.lit(0))
    marked = rows.withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("__run = 0").drop("__gap", "__run")


def versions(rows: DataFrame, key: Sequence[str], order: str, as_of: int) -> DataFrame:
    """Rows known by ``as_of`` with their version, from 1 in the order they became known, and whether it is the latest known."""
    known = rows.where(F.col(order) <= as_of)
    w = Window.partitionBy(*key).orderBy(order)
    return known.withColumn("version", F.row_number().over(w)).withColumn("latest", F.lead(order).over(w).isNull())


# -- statistics


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: the weighted least-squares slope over rows of positive weight with a y; null without spread or with one row."""
    keep = (w > 0) & y.isNotNull()
    s = [F.sum(F.when(keep, v)) for v in (w, w * x, w * y, w * x * x, w * x * y)]
    below = s[0] * s[3] - s[1] * s[1]
    return F.when((F.count_if(keep) > 1) & (below > 0), (s[0] * s[4] - s[1] * s[2]) / below)


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*group).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0


def within_slope(rows: DataFrame, y: str, x: str, effect: str, cluster: str) -> DataFrame:
    """Slope of y on x after taking each effect's means out, with its cluster-robust error (CR1), in one row."""
    w = Window.partitionBy(effect)
    r = rows.select(cluster, (F.col(y) - F.avg(y).over(w)).alias("y"), (F.col(x) - F.avg(x).over(w)).alias("x"))
    sums = r.groupBy(cluster).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"))
    beta = F.col("sxy") / F.col("sxx")
    each = sums.join(F.broadcast(total)).withColumn("score", F.col("xy") - beta * F.col("xx"))
    g = F.count(F.lit(1))
    return each.groupBy("sxy", "sxx").agg(F.sum(F.col("score") * F.col("score")).alias("meat"), g.alias("clusters"), F.sum("n").alias("n")).select(
        beta.alias("beta"), F.sqrt(F.col("meat") * F.col("clusters") / (F.col("clusters") - 1)).alias("_"), "clusters", "n", F.col("sxx")
    ).select("beta", (F.col("_") / F.col("sxx")).alias("se"), "clusters", "n")


def cluster_bootstrap(sums: DataFrame, replicates: int, seed: int, stream: str) -> DataFrame:
    """(replicate, mean) over clusters (i from 0, total, n), drawn with replacement by a counter stream.

    Draw j of a replicate takes cluster floor(u * clusters) with u from the first 52 bits of its
    hash. There are as many draws as clusters, so rows are replicates times clusters, spread over the
    executors; clusters are days or months.
    """
    draws = sums.select(F.col("i").alias("j"), F.count(F.lit(1)).over(Window.partitionBy()).alias("g")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), F.col("replicate").cast("string"), F.col("j").cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    picked = draws.withColumn("i", F.floor(u * F.col("g")).cast("long")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("times"))
    return picked.join(sums, "i").groupBy("replicate").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("n"))).alias("mean"))
