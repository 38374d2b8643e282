"""Bars, as-of joins and exact numbers on hand-made rows; features never change with the future."""

import pytest
from pyspark.sql import functions as F

from quantloom.functions import calendar, exact
from quantloom.operators import asof, bars, movement, reports, rolling

HOUR = calendar.HOUR


def trades(spark, rows):
    return spark.createDataFrame(rows, "symbol string, id long, ms long, price long, qty long, maker boolean")


def test_bar_opens_and_closes_by_id(spark):
    b = bars.minute_bars(trades(spark, [("a", 2, 10, 5, 1, True), ("a", 1, 20, 9, 2, False), ("a", 3, 5, 7, 3, False)]), 1).first()
    assert (b.open, b.close, b.high, b.low, b.volume, b.taker_volume) == (9, 7, 9, 5, 6, 5)


def test_missing_bar_voids_the_candle_and_tail_is_not_built(spark):
    rows = [("a", k, h * HOUR, 10 + h, 1, False) for k, h in enumerate([0, 1, 2, 3, 4, 6, 7, 8])]
    out = {r.open_ms: r.valid for r in bars.candles(bars.dense(bars.minute_bars(trades(spark, rows), 60), 60), 240, 60).collect()}
    assert out == {0: True, 4 * HOUR: False}


def test_asof_ties_nulls_and_gap(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, 5)], "symbol string, id long, ms long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 20, None)], "symbol string, at_ms long, v double")
    out = {r.id: (r.v, r.matched_at) for r in asof.asof_backward(left, right, "symbol", "ms", "at_ms", ["v"]).collect()}
    assert out == {1: (1.0, 10), 2: (None, 20), 3: (None, None)}
    near = {r.id: r.matched_at for r in asof.asof_backward(left, right, "symbol", "ms", "at_ms", ["v"], max_gap=5).collect()}
    assert near == {1: 10, 2: None, 3: None}
    strict = {r.id: r.matched_at for r in asof.asof_backward(left, right, "symbol", "ms", "at_ms", ["v"], strict=True).collect()}
    assert strict[1] is None


def test_interval_bounds(spark):
    points = spark.createDataFrame([("a", t) for t in (10, 20, 30)], "k string, t long")
    spans = spark.createDataFrame([("a", 10, 30)], "k string, s long, e long")
    got = lambda closed: sorted(r.t for r in asof.interval_join(points, spans, "k", "t", "s", "e", 7, closed).collect())
    assert got("left") == [10, 20] and got("right") == [20, 30]


def test_barrier_rules(spark):
    bars_ = spark.createDataFrame([("a", 0, 12, 9), ("a", 1, 12, 8), ("a", 2, 20, 9)], "symbol string, open_ms long, high long, low long")
    entry = lambda i, stop, target: ("a", i, 0, 1, stop, target)
    entries = spark.createDataFrame([entry(1, 9, 99), entry(2, 1, 12), entry(3, 8, 11), entry(4, 1, 19)], "symbol string, id long, entry_ms long, side int, stop long, target long")
    out = {r.id: (r.pess, r.opt) for r in asof.first_touch(entries, bars_, 10).collect()}
    # the entry bar stops; touching is not going through; both in one bar is ambiguous
    assert out == {1: ("S", "S"), 2: ("T", "T"), 3: ("S", "T"), 4: ("T", "T")}


@pytest.mark.parametrize("text,scaled", [("1.5", 150000000), ("1e-8", 1), ("0.123456789", None), ("-2", -200000000), ("x", None), ("0.12345678", 12345678)])
def test_parse_scaled(spark, text, scaled):
    got = spark.createDataFrame([(text,)], "t string").select(exact.parse_scaled(F.col("t")).alias("v")).first().v
    assert (None if got is None else int(got)) == scaled


def test_render_and_ratio(spark):
    row = spark.range(1).select(
        *[exact.render_scaled(F.lit(v)).alias(f"r{k}") for k, v in enumerate((150000000, -1, 0, 100000000))], exact.ratio_text(F.lit(6), F.lit(-4)).alias("q"), exact.half_even(F.lit(0.125), 2).cast("string").alias("h")
    ).first()
    assert (row.r0, row.r1, row.r2, row.r3, row.q, row.h) == ("1.5", "-0.00000001", "0", "1", "-3/2", "0.12")


def test_right_closed_bucket(spark):
    row = spark.range(1).select(*[calendar.right_closed(F.lit(v)).alias(f"b{v}") for v in (5000, 5001, 4999)]).first()
    assert list(row) == [5000, 10000, 5000]


def test_weights_are_capped(spark):
    w = spark.range(1).select(movement.capped_weights(F.array(*[F.lit(float(v)) for v in (100, 1, 1, 1, 1)])).alias("w"), movement.capped_weights(F.array(F.lit(1.0), F.lit(2.0))).alias("n")).first()
    assert max(w.w) <= 0.25 + 1e-9 and sum(w.w) == pytest.approx(1) and w.n is None


def test_holm_and_bh(spark):
    p = spark.createDataFrame([(0.01,), (0.02,), (0.04,)], "p double")
    assert [round(r.holm, 4) for r in reports.holm(p, "p").orderBy("p").collect()] == [0.03, 0.04, 0.04]
    assert [round(r.q, 4) for r in reports.benjamini_hochberg(p, "p").orderBy("p").collect()] == [0.03, 0.03, 0.04]


def test_features_do_not_look_ahead(spark):
    def frame(last):
        closes = [100 + (k * 37) % 23 for k in range(60)] + [last] * 5
        return spark.createDataFrame([("a", k * HOUR, c, c + 2, c - 2, c, 10 + c % 5, 5) for k, c in enumerate(closes)], "symbol string, open_ms long, open long, high long, low long, close long, volume long, taker_volume long")

    def features(f):
        c = F.col("close")
        rows = f.select("symbol", "open_ms", "close", rolling.rolling_mean(c, 5).alias("m"), rolling.rolling_std(c, 5).alias("s"), rolling.trailing_rank(c, 10).alias("r"), rolling.bollinger_side(c).alias("b"), rolling.efficiency_ratio(c, 5).alias("e"), rolling.prior_extremes(c, 5)[0].alias("x"))
        rows = rolling.robust_z(rows.withColumn("d", c.cast("double")), "d", rolling.earlier(1), 5)
        return rows.where(F.col("open_ms") < 60 * HOUR).orderBy("open_ms").collect()

    assert features(frame(1)) == features(frame(10_000))


def test_empty_frames_give_empty_results(spark):
    none = trades(spark, [])
    assert bars.minute_bars(none).count() == 0
    assert bars.missing_ranges(bars.minute_bars(none), 1).count() == 0
