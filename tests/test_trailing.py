"""Scores against a moving sorted list equal those against each frame sorted anew."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions.calendar import DAY
from quantloom.operators import trailing


def plain(times, values, reach, least):
    out = []
    for t, x in zip(times, values, strict=True):
        held = sorted(v for u, v in zip(times, values, strict=True) if t - reach <= u < t and v is not None)
        z = None
        if x is not None and held and len(held) >= least:
            mid = trailing.middle(held)
            spread = trailing.middle(sorted(abs(v - mid) for v in held))
            z = (x - mid) / (1.4826 * spread) if spread > 0 else None
        out.append(z)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_scores(seed):
    lots = random.Random(seed)
    times = sorted(lots.randrange(200) for _ in range(150))  # ties
    values = [lots.choice([None, 3.0, 3.0, float(lots.randrange(10)), lots.random()]) for _ in times]
    assert trailing.scores(times, values, 40, 3, 1.4826) == plain(times, values, 40, 3)


def test_nan_and_empty():
    assert trailing.scores([], [], 5, 1, 1.0) == []
    assert trailing.scores([1, 2, 3, 4], [1.0, float("nan"), 3.0, 5.0], 9, 2, 1.0) == [None, None, None, 3.0]


@pytest.mark.parametrize("span", [3 * DAY, 90 * DAY])
def test_spans(spark, span):
    lots = random.Random(2)
    rows = [(lots.choice(["a", "b", None]), i * DAY // 4, lots.choice([None, lots.randrange(50)]), "x") for i in range(200)]
    frame = spark.createDataFrame(rows, "symbol string, open_ms long, v int, other string")
    found = trailing.robust_z(frame, "v", 7, 3, span=span)
    assert found.columns == ["symbol", "open_ms", "v", "other", "z"]
    got = {r.open_ms: r.z for r in found.collect()}
    assert len(got) == 200
    for k in ("a", "b", None):
        mine = [r for r in rows if r[0] == k]
        assert [got[r[1]] for r in mine] == plain([r[1] for r in mine], [r[2] for r in mine], 7 * DAY, 3)
    assert trailing.robust_z(frame.limit(0), "v", 7, 3).count() == 0


@pytest.mark.parametrize(("behind", "ahead", "span"), [(20, -1, 7), (20, 0, 50), (0, 0, 5), (3, 9, 4), (-2, 9, 1000)])
def test_moving_sums(spark, behind, ahead, span):
    lots = random.Random(5)
    rows = [(i, lots.choice(["a", "b", None]), lots.choice([None, *range(-40, 60)]), lots.choice([None, 2**62, lots.randrange(9)])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, k string, at long, v long")
    found = trailing.moving_sums(frame, "k", "at", {"s": F.col("v"), "n": F.lit(1)}, behind, ahead, span)
    assert found.columns == ["id", "k", "at", "v", "s", "n"]

    def held(k, t):
        return [r[3] for r in rows if r[1] == k and (r[2] is None if t is None else r[2] is not None and t - behind <= r[2] <= t + ahead)]

    got = {r.id: (int(r.s), int(r.n)) for r in found.collect()}
    assert got == {i: (sum(v or 0 for v in held(k, t)), len(held(k, t))) for i, k, t, _ in rows}
    assert trailing.moving_sums(frame.limit(0), "k", "at", {"n": F.lit(1)}, 5).count() == 0
