"""Streams against replays, late rows, ingest; archives round trip."""

import io
import json
import lzma
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quantloom.sources import archives
from quantloom.streaming import ingest
from quantloom.streaming import stateful as s


def line(ms, i, price, qty=1):
    return dict(ms=ms, id=i, price=price, qty=qty)


def test_buckets_are_right_closed_and_wait_for_grace():
    state, out = s.buckets({}, [line(1000, 1, 10), line(5000, 2, 12), line(6999, 3, 11)])
    assert out == []
    state, out = s.buckets(state, [line(7000, 4, 13)])
    assert [(o["boundary_ms"], o["open"], o["close"], o["trades"]) for o in out] == [(5000, 10, 12, 2)]


def test_late_rows_are_counted_and_dropped():
    state, _ = s.buckets({}, [line(1000, 1, 10), line(9000, 2, 12)])
    state, out = s.buckets(state, [line(4000, 3, 99), line(13000, 4, 13)])
    assert state["late"] == 1 and out[0]["high"] == 12


def test_carry_expires():
    _, out = s.buckets({}, [line(4000, 1, 10), line(40000, 2, 11)])
    assert [o["status"] for o in out] == ["LIVE", "CARRIED", "CARRIED", "MISSING", "MISSING", "MISSING", "MISSING"]
    assert s.ready(["LIVE"] * 25)[25] and not s.ready(["MISSING"] + ["LIVE"] * 24)[25]


def test_same_time_is_ordered_by_id():
    _, out = s.buckets({}, [line(1000, 2, 20), line(1000, 1, 10), line(8000, 3, 1)])
    assert (out[0]["open"], out[0]["close"]) == (10, 20)


def test_state_survives_json_at_any_cut():
    rnd = random.Random(1)
    rows = [line(t, k, rnd.randint(1, 99)) for k, t in enumerate(sorted(rnd.sample(range(1, 200_000), 120)))]
    _, whole = s.buckets({}, rows)
    for cut in (1, 40, 119):
        state, a = s.buckets({}, rows[:cut])
        _, b = s.buckets(json.loads(json.dumps(state)), rows[cut:])
        assert a + b == whole


def test_episode_replays_are_idempotent():
    engine = s.episode_engine()
    rows = [dict(boundary_ms=k, state=x, continues=False) for k, x in enumerate(["BROAD_RISE", "BROAD_RISE", "NEUTRAL", "NEUTRAL", "NEUTRAL"], 1)]
    state, out = engine({}, rows)
    assert [o["transition"] for o in out] == ["START", "END"]
    assert engine(state, rows) == (state, [])
    assert s.interrupted({"side": 1, "at": 9})["side"] == 0


@pytest.mark.parametrize("engine,schema", [(s.buckets, s.BUCKET_SCHEMA), (s.alerts(20.0, 30_000), s.ALERT_SCHEMA)])
def test_stream_equals_replay(spark, tmp_path, engine, schema):
    rnd = random.Random(6)
    rows = [(x, k, t, rnd.randint(50, 150), 1) for x in "ab" for k, t in enumerate(sorted(rnd.sample(range(1, 300_000), 90)))]
    for part in range(3):
        lines = [json.dumps(dict(zip(("symbol", "id", "ms", "price", "qty"), r, strict=True))) for r in rows if r[1] // 30 == part]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
    kind = "symbol string, id long, ms long, price long, qty long"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    out = s.streamed(stream, "symbol", ["ms", "id"], engine, schema)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(repr, s.replayed(spark.createDataFrame(rows, kind), "symbol", ["ms", "id"], engine, schema).collect()))
    assert got == want and got


def test_first_write_wins(spark, tmp_path):
    table, conflicts = str(tmp_path / "t"), str(tmp_path / "c")
    put = ingest.first_write_wins(table, conflicts, ["k"], ["v", "w"])
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int, w int")
    put(frame([(1, 1, 1), (2, 2, 2)]), 0)
    put(frame([(1, 1, 9), (3, 3, 3), (2, 2, 2)]), 1)
    put(frame([(1, 1, 9), (3, 3, 3), (2, 2, 2)]), 1)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
    assert [(r.k, list(r.fields), r.batch) for r in spark.read.parquet(conflicts).collect()] == [(1, ["w"], 1)]


def test_latest_state_is_monotonic(spark):
    rows = spark.createDataFrame([("a", 5, "new"), ("a", 3, "old"), ("b", 1, "x")], "k string, boundary long, state string")
    assert {r.k: r.state for r in ingest.latest_state(rows, ["k"], "boundary").collect()} == {"a": "new", "b": "x"}


def test_reconcile_within_tolerance(spark):
    kind = "struct<open:double,high:double,low:double,close:double,volume:double>"
    rows = spark.createDataFrame([(1, (1.0, 1.0, 1.0, 1.0, 100.0), (1.001, 1.0, 1.0, 1.0, 101.0)), (2, (1.0, 1.0, 1.0, 1.0, 100.0), (1.1, 1.0, 1.0, 1.0, 100.0))], f"k int, stored {kind}, offered {kind}")
    assert {r.k: r.revise for r in ingest.reconciled(rows).collect()} == {1: True, 2: False}


# -- archives


def zipped(text):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", text)
    return held.getvalue()


def test_zip_csv_skips_header_and_checks_fields(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped("agg_trade_id,price\n1,2.5\n2,3.5\n"))
    (tmp_path / "b.zip").write_bytes(zipped("3,1e-8\n"))
    rows = archives.read_zip_csv(spark, str(tmp_path), "agg_trade_id long, price string").collect()
    assert sorted((r.agg_trade_id, r.price) for r in rows) == [(1, "2.5"), (2, "3.5"), (3, "1e-8")]
    with pytest.raises(ValueError, match="fields"):
        list(archives.zip_rows(zipped("1,2,3\n"), 2))


def test_archive_trades_are_exact_and_unique(spark):
    raw = spark.createDataFrame([(1, "0.1", "2", 5, 7, 99, "true"), (1, "0.1", "2", 5, 7, 99, "True"), (2, "3", "4", 8, 8, 100, "false")], archives.TRADE_COLUMNS)
    rows = {r.id: (r.price, r.qty, r.maker, r.fills) for r in archives.trades_of(raw, F.lit("X")).collect()}
    assert rows == {1: (10_000_000, 200_000_000, True, 3), 2: (300_000_000, 400_000_000, False, 1)}


def test_ticks():
    data = lzma.compress(struct.pack(">IIIff", 250, 110_010, 110_000, 1.0, 2.0))
    assert archives.ticks(data, 1000, 100_000) == [(1250, 110_010_000, 110_000_000, 1.0, 2.0)]
    assert archives.ticks(b"", 0, 1) == []
    with pytest.raises(ValueError, match="record"):
        archives.ticks(lzma.compress(b"abc"), 0, 1)


def test_klines_of_three_providers(spark):
    bodies = {
        "binance": '[[60000,"1","3","0.5","2","9",119999]]',
        "okx": '{"data":[["60000","1","3","0.5","2","9","0","0","1"],["120000","1","1","1","1","1","0","0","0"]]}',
        "kraken": '{"error":[],"result":{"XBT":[[60,"1","3","0.5","2","1.5","9",4]],"last":60}}',
    }
    for provider, body in bodies.items():
        rows = archives.klines_of(spark.createDataFrame([(body,)], "body string"), provider).collect()
        assert [tuple(r) for r in rows] == [(60000, 1.0, 3.0, 0.5, 2.0, 9.0)]


def test_stream_messages(spark):
    trade = '{"data":{"e":"aggTrade","s":"X","a":7,"p":"1.5","q":"2","T":123,"m":true}}'
    candle = '{"e":"kline","s":"X","k":{"t":60000,"T":119999,"i":"1m","o":"1","h":"2","l":"1","c":"2","v":"3","x":true}}'
    rows = archives.stream_messages(spark.createDataFrame([(trade,), (candle,), ('{"e":"other"}',), ("no json",)], "value string")).collect()
    assert {(r.kind, r.id, r.ms, r.open_ms, r.closed) for r in rows} == {("aggTrade", 7, 123, None, None), ("kline", None, 119999, 60000, True)}


def test_calendar_labels_and_metrics(spark):
    body = '[{"title":"CPI","country":"usd","date":"2024-01-02T08:30:00-05:00","impact":"High"},{"title":"x","country":"All","date":"bad","impact":"Low"}]'
    rows = archives.calendar_events(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.ts_ms, r.currency, r.impact) for r in rows] == [(1704202200000, "USD", "high")]
    cells = archives.labels_of(spark.createDataFrame([("T:5:100:2:0|S:5:-100:2:0;E:9:1:2:3",)], "cells string")).first().cells
    assert (cells[0].pess.outcome, cells[0].opt.net_ur, cells[1].opt.outcome) == ("T", -100, "E")
    raw = spark.createDataFrame([("2024-01-01 00:05:00", "X", *[1.0] * 6), ("1704067500000", "X", *[1.0] * 6), ("bad", "X", *[1.0] * 6)], archives.METRIC_COLUMNS)
    assert [r.usable_from_ms for r in archives.metrics_of(raw).collect()] == [1704067800000]


def test_guard_and_partitioned_bars(spark, tmp_path):
    with pytest.raises(archives.AccessError):
        archives.guarded(["2024-01"], "2024-01", None, "t")
    assert archives.guarded(["2024-01"], "2024-01", "t", "t") == ["2024-01"]
    bars = spark.createDataFrame([("X", 1704067200000, 5), ("X", 1706745600000, 6), ("Y", 1704067200000, 7)], "symbol string, open_ms long, close long")
    archives.write_bars(bars, str(tmp_path / "b"))
    found = archives.read_months(spark, str(tmp_path / "b"), "X", ["2024-02"])
    assert [r.close for r in found.collect()] == [6]
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString()


def test_append_only_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    path = str(tmp_path / "l")
    assert [archives.append_new(spark, rows, path, ["id"]) for _ in range(2)] == [2, 0]


def test_variance_state_equals_the_recursion():
    from quantloom.operators.sequential import block_variance

    rnd = random.Random(9)
    prices = [rnd.choice([None, rnd.randint(50, 150)]) for _ in range(80)]
    rows = [dict(ms=k, price=p) for k, p in enumerate(prices)]
    engine = s.variance_engine(5, 3)
    state, one = engine({}, rows[:33])
    _, other = engine(json.loads(json.dumps(state)), rows[33:])
    want = [None if v is None else str(v) for v in block_variance(prices, 5, 3)]
    assert [r["variance"] for r in one + other] == want


def test_wallet_state_equals_the_whole_ledger():
    from quantloom.operators.sequential import wallet

    rnd = random.Random(3)
    events = [dict(ms=t, type=kind, id=k, value=rnd.randint(-900_000, 900_000)) for k in range(40) for t, kind in ((2 * k, "open"), (2 * k + rnd.randint(1, 9), rnd.choice(["close", "liquidation", "funding"])))]
    engine = s.wallet_engine(10**9, 200, 3)
    state, one = engine({}, [e for e in events if e["ms"] < 40])
    _, other = engine(json.loads(json.dumps(state)), [e for e in events if e["ms"] >= 40])
    assert one + other == wallet(events, 10**9, 200, 3)
