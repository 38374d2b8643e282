"""Ranks dealt in parts equal those of one sorted list: ties, nulls, hot values, empty tables, null groups."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import ranks

SCHEMA = "g string, v long, k long"


@pytest.fixture(scope="module")
def rows():
    lots = random.Random(5)
    made = [(lots.choice(["a", "a", "a", "b", None]), lots.choice([7, 7, 7, None, lots.randrange(100)]), k) for k in range(2000)]
    lots.shuffle(made)
    return made


def lowest(row):
    return (row[1] is not None, row[1] or 0, row[2])


def test_ranked(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = ranks.ranked(frame, "v", "k", parts=8)
    assert {r.k: (r["rank"], r.n) for r in whole.collect()} == {r[2]: (i, 2000) for i, r in enumerate(sorted(rows, key=lowest), 1)}
    grouped = {r.k: (r["rank"], r.n) for r in ranks.ranked(frame, "v", "k", ["g"], parts=8).collect()}
    for g in ("a", "b", None):
        members = sorted((r for r in rows if r[0] == g), key=lowest)
        assert all(grouped[r[2]] == (i, len(members)) for i, r in enumerate(members, 1))


def test_hot_value_is_dealt(spark, rows):
    """No part holds more than a small share of the rows, though one value holds most of them."""
    frame = ranks._parted(spark.createDataFrame(rows, SCHEMA), "v", "k", 8)
    assert frame.groupBy("__part").count().agg(F.max("count")).first()[0] < 400


def test_order_statistics(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.g: (r.low, r.mid, r.top) for r in ranks.nearest_ranks(frame, ["g"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}, parts=8).collect()}
    means = {r.g: r["mean"] for r in ranks.trimmed_means(frame, ["g"], "v", 0.1, parts=8).collect()}
    for g in ("a", "b", None):
        held = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        assert found[g] == (held[0], held[-(-len(held) // 2) - 1], held[-1])
        cut = len(held) // 10
        assert means[g] == pytest.approx(sum(held[cut : len(held) - cut]) / (len(held) - 2 * cut))


def test_equal_parts(spark):
    for n in (1, 3, 5, 13):
        got = spark.range(1, n + 1).select("id", ranks.equal_parts(F.col("id"), F.lit(n), 5).alias("p"), F.expr("ntile(5) over (order by id)").alias("t")).collect()
        assert all(r.p == r.t for r in got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranks.ranked(empty, "v", "k").count() == 0
    assert ranks.nearest_ranks(empty, ["g"], "v", {"mid": 0.5}).count() == 0
