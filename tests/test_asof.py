"""As-of joins in spans equal a plain search: spans without rows, ties, strictness, gaps, nulls, empty sides."""

import random

import pytest

from quantloom.operators import asof


def searched(left, right, strict, max_gap):
    out = {}
    for i, k, t in left:
        fits = [(at, v) for rk, at, v in right if None not in (k, t, rk, at) and rk == k and (at < t if strict else at <= t)]
        at, v = max(fits, default=(None, None))
        out[i] = (v, at) if at is not None and (max_gap is None or t - at <= max_gap) else (None, None)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("max_gap", [None, 30])
def test_asof(spark, strict, max_gap):
    lots = random.Random(3)
    left = [(i, lots.choice(["a", "a", "b", "c", None]), lots.choice([None, *range(0, 400, 7)])) for i in range(300)]
    right = [(lots.choice(["a", "b", None]), lots.choice([None, 7, 14, lots.randrange(150), lots.randrange(300, 320)]), lots.randrange(9)) for _ in range(120)]
    l, r = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, at long, v int")
    found = asof.asof_backward(l, r, "k", "t", "at", ["v"], max_gap, strict, span=20)
    assert found.columns == ["id", "k", "t", "v", "matched_at"]
    assert {x.id: (x.v, x.matched_at) for x in found.collect()} == searched(left, right, strict, max_gap)


def test_empty(spark):
    l, r = spark.createDataFrame([], "id int, k string, t long"), spark.createDataFrame([], "k string, at long, v int")
    assert asof.asof_backward(l, r, "k", "t", "at", ["v"]).count() == 0
    one = spark.createDataFrame([(1, "a", 5)], "id int, k string, t long")
    assert [tuple(x) for x in asof.asof_backward(one, r, "k", "t", "at", ["v"]).collect()] == [(1, "a", 5, None, None)]


@pytest.mark.parametrize("blocks", [1, 4, 16, 100])
def test_first_touch(spark, blocks):
    lots = random.Random(blocks)
    bars = []
    for symbol in "ab":
        price = 100
        for t in range(0, 400, 5):
            if lots.random() < 0.9:
                price += lots.randrange(-6, 7)
                bars.append((symbol, t, price + lots.randrange(5), price - lots.randrange(5)))
    entries = [(s, i, t, side, 100 - side * lots.randrange(1, 25), 100 + side * lots.randrange(1, 25)) for i, (s, t, side) in enumerate((lots.choice("abc"), lots.randrange(-20, 420), lots.choice([1, -1])) for _ in range(150))]
    e = spark.createDataFrame(entries, "symbol string, id int, entry_ms long, side int, stop long, target long")
    b = spark.createDataFrame(bars, "symbol string, open_ms long, high long, low long")
    found = {r.id: (r.stop_ms, r.target_ms, r.pess, r.opt) for r in asof.first_touch(e, b, 60, blocks).collect()}
    for s, i, t, side, stop, target in entries:
        seen = [(at, h, w) for k, at, h, w in bars if k == s and t <= at < t + 60]
        stops = [at for at, h, w in seen if (w <= stop if side > 0 else h >= stop)]
        goals = [at for at, h, w in seen if at > t and (h > target if side > 0 else w < target)]
        x, y = min(stops, default=None), min(goals, default=None)
        far = 10**9
        p, o = (far if x is None else x), (far if y is None else y)
        pess, opt = ("E", "E") if p == o == far else ("S" if p <= o else "T", "T" if o <= p else "S")
        assert found[i] == (x, y, pess, opt)
