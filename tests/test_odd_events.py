"""Queries on events such as the smallest tables don't have agree with their SQL, or with the reference where they have none."""

import random

import duckdb
import pytest
from test_catalogue import rows_of

from quantloom.operators import sequential, studies
from quantloom.plans import catalogue


@pytest.fixture
def events(tmp_path):
    """Writes rows of (event_id, seconds, event_type, value, k) as the table of events and returns its folder."""

    def write(rows):
        con = duckdb.connect()
        con.execute("create table e (id bigint, s bigint, kind varchar, value double, k bigint)")
        con.executemany("insert into e values (?, ?, ?, ?, ?)", rows)
        con.execute(f"""copy (select id as event_id, timestamp '2024-01-01' + to_seconds(s) as ts, 1::bigint as user_id, kind as event_type, value,
            case when k is not null then '{{"k": ' || k || '}}' end as props from e) to '{tmp_path}/events.parquet'""")
        return str(tmp_path)

    return write


def same(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    cursor = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    rows = found.collect()
    assert rows_of(found.columns, rows) == rows_of(columns, cursor.fetchall())
    return rows


def test_follow_through_from_and_to_zero(spark, events):
    closes = [5, 7, 0, 6, 3, 4, 9, 8, 0, 0, 2, 1, 3, 5, 4, 6, 7, 2]
    rows = [(2 * i + e, i * 14_400 + 60 * e, "a", v, 1) for i, c in enumerate(closes) for e, v in enumerate([c + (-1) ** i if c else 1, c])]
    rows += [(100, 0, "b", None, 1), (101, 14_400, "b", 3, 1)]
    found = same(spark, events(rows), "follow_through")
    assert {r.mfe_bp for r in found} & {float("inf"), float("-inf")} and {r.ret_bp for r in found} & {float("inf"), float("-inf")}


def test_value_area_without_prices_that_have_no_logarithm(spark, events):
    day = 86_400
    rows = [(1, 0, "a", 100, 10), (2, 1, "a", 0, 99), (3, 2, "a", None, 99), (4, 3, "a", -5, 99), (5, day, "a", 0, 7), (6, 8 * day, "a", 0, 7), (7, 0, "b", 100, 0), (8, day, "b", 100, None)]
    found = catalogue.QUERIES["value_area"](spark, events(rows))
    first, bin_ = 19_723, 184  # ln(10000) / 0.05
    assert sorted(map(tuple, found.collect())) == [("a", first, bin_, bin_, bin_), ("a", first + 1, bin_, bin_, bin_)]


def test_value_area_of_nothing():
    assert sequential.value_area({}) is None
    assert sequential.value_area({3: 0, 5: 0}) is None


def odd_trades(n=300):
    lots = random.Random(3)
    kinds = [None, "a", "a", "a", "b"]
    times = [lots.randrange(70 * 86_400) if i % 3 else 86_400 * lots.randrange(70) for i in range(n)]  # ties, and frames that begin at a row
    return [(i, t, lots.choice(kinds), lots.choice([None, 0, 12.34, 50, 90, lots.random() * 400]), i % 7) for i, t in enumerate(times)]


@pytest.mark.parametrize("name", ["range_mean_30d", "funding_rate_mean"])
def test_means_over_time(spark, events, name):
    rows = [*odd_trades(), *[(1000 + i, 100 * 86_400 + i, "c", None if i < 9 else 5, 1) for i in range(12)]]
    assert len(same(spark, events(rows), name)) == len(rows)
    plan = catalogue.QUERIES[name](spark, events(rows))._jdf.queryExecution().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan  # nothing is summed anew for each row


def test_liquidations(spark, events):
    day = 86_400
    rows = [(i, t // 20, kind, v, k) for i, t, kind, v, k in odd_trades(400)]
    rows += [(2000, 0, "c", 10, 1), (2002, day, "c", 4, 1), (2003, 0, "d", 10, 1), (2005, day - 1, "d", 15, 1), (2007, 2 * day - 1, "d", 100, 1)]  # a window's end is outside it
    rows += [(2000, 5, "c", 6, 1), (2009, 5, "e", 0, 1), (None, 6, "e", 8, 1), (None, 7, "e", 20, 1)]  # repeated ids and none
    found = {(r.symbol, r.id): r.liquidated_ms for r in same(spark, events(rows), "liquidation_scan")}
    assert len(found) == len(rows) - 2 and sum(v is not None for v in found.values()) > 50
    assert found["d", 2003] is not None and found["d", 2005] is None
    plan = catalogue.QUERIES["liquidation_scan"](spark, events(rows))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan  # no pairs


@pytest.mark.parametrize("window", [0, 1, 7, 30])
def test_first_breaches(window):
    lots = random.Random(4)
    times = sorted(lots.randrange(60) for _ in range(120))
    marks = [lots.randrange(30) for _ in times]
    opened = sorted(lots.randrange(-5, 70) for _ in range(150))
    levels = [lots.randrange(-2, 25) for _ in opened]
    want = [min((t for t, m in zip(times, marks, strict=True) if a <= t < a + window and m <= x), default=None) for a, x in zip(opened, levels, strict=True)]
    assert studies.first_breaches(times, marks, opened, levels, window) == want
