"""Frames dealt in spans equal those over the whole series; state paths tell what they don't know."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import context

R, D, N = context.RISE, context.DROP, context.NEUTRAL


def told(spark, states, steps=2, end=10):
    rows = [("a", t, s, end) for t, s in states.items()]
    found = context.state_paths(spark.createDataFrame(rows, "k string, at long, state string, end long"), "k", "at", "state", 1, steps, "end", span=3)
    return {r["at"]: tuple(r)[2:] for r in found.collect()}


def test_state_paths(spark):
    found = told(spark, {0: R, 1: N, 2: D, 3: N, 4: None, 5: R, 7: D, 8: D})
    assert found[0] == (R, D, "AVAILABLE", False, "REVERSED", "OBSERVED_REVERSAL", 2)
    assert found[1] == (N, N, "AVAILABLE", True, None, "NOT_APPLICABLE", None)
    assert found[2] == (D, None, "UNAVAILABLE", None, None, "UNAVAILABLE", None)
    assert found[3] == (N, R, "AVAILABLE", False, None, "NOT_APPLICABLE", None)
    assert found[5] == (None, None, "UNAVAILABLE", None, None, "UNAVAILABLE", None)
    assert found[8] == (None, None, "CENSORED", None, None, "CENSORED", None)
    assert told(spark, {0: R, 1: None, 2: R})[0] == (R, R, "AVAILABLE", True, "PERSISTED", "UNAVAILABLE", None)
    assert told(spark, {0: D, 1: D, 2: N})[0] == (D, N, "AVAILABLE", False, "WEAKENED", "CENSORED_NO_REVERSAL", None)
    assert told(spark, {}) == {}


@pytest.mark.parametrize("span", [7, 50, 10_000])
def test_dealt_frames_equal_whole_ones(spark, span):
    lots = random.Random(1)
    rows = spark.createDataFrame([(lots.choice("ab"), lots.randrange(-200, 200), lots.randrange(9)) for _ in range(300)], "k string, at long, v long")

    def total(*keys):
        return F.sum("v").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(-20, 5)).alias("s")

    parted = context.settle(context.dealt(rows, "at", span, behind=20, ahead=5).select("*", total("k", "__span")))
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, rows.select("*", total("k")).collect()))
