"""Month files: strict readers raise on faults, equal rows give equal bytes, archives come out the same when run again."""

import pytest
from pyspark.sql import functions as F

from quantloom.sources import archives, lake

SCHEMA = "open_time_ms long, open string, high string, low string, close string, volume string, trades long, premium_close string, index_close string, flags int"
START, STEP = 1_704_067_200_000, 86_400_000  # 2024-01-01, daily steps


def month(spark, days=31, **spoilt):
    rows = spark.range(days).select(
        F.lit("a").alias("symbol"), F.lit("2024-01").alias("month"), (START + F.col("id") * STEP).alias("open_time_ms"), *[F.lit("1.5").alias(c) for c in ("open", "high", "low", "close")],
        F.lit("0").alias("volume"), F.lit(0).cast("long").alias("trades"), F.lit("-0.1").alias("premium_close"), F.lit("2").alias("index_close"), F.lit(0).alias("flags"),
    )
    for name, value in spoilt.items():
        rows = rows.withColumn(name, F.expr(value))
    return rows


def test_whole_month(spark):
    assert lake.bars_month(month(spark), 1440).count() == 31
    assert {r.premium_close for r in lake.premium_month(month(spark), 1440).collect()} == {-10_000_000}


@pytest.mark.parametrize("rows", [
    {"days": 30}, {"days": 32}, {"open_time_ms": "open_time_ms + if(open_time_ms % 7 = 3, 1, 0) + 1"}, {"close": "'-1'"}, {"open": "'x'"},
])
def test_faulty_bars_raise(spark, rows):
    with pytest.raises(Exception, match="gap or repeated|bad price"):
        lake.bars_month(month(spark, **rows), 1440).collect()


def test_repeated_and_missing_steps_raise(spark):
    m = month(spark)
    for rows in (m.unionByName(m.where(f"open_time_ms = {START + STEP}")), m.where(f"open_time_ms <> {START + 4 * STEP}")):
        with pytest.raises(Exception, match="gap or repeated"):
            lake.bars_month(rows, 1440).collect()


def test_premium_and_flag_must_agree(spark):
    for spoilt in ({"premium_close": "cast(null as string)"}, {"flags": "32"}):
        with pytest.raises(Exception, match="disagree"):
            lake.premium_month(month(spark, **spoilt), 1440).collect()


def test_funding_out_of_place_raises(spark):
    def funding(*times):
        return spark.createDataFrame([("a", "2024-01", t, 8, "0.0001", "0.0001") for t in times], "symbol string, month string, calc_time_ms long, funding_interval_hours int, last_funding_rate string, last_funding_rate_published string")

    assert [r.rate for r in lake.funding_months(funding(START, START + 1)).collect()] == [10_000, 10_000]
    assert lake.funding_months(funding()).count() == 0
    for times in ((START, START), (START - 1,), (START + 31 * STEP,)):
        with pytest.raises(Exception, match="out of place"):
            lake.funding_months(funding(*times)).collect()


def test_other_header_raises_and_bytes_are_stable(spark, tmp_path):
    columns = [part.split()[0] for part in SCHEMA.split(", ")]
    for name in ("one", "two"):
        lake.write_months(month(spark).orderBy(F.rand()), str(tmp_path / name), "open_time_ms", columns)
    one, two = ([p.read_bytes() for p in sorted((tmp_path / n).rglob("*.gz"))] for n in ("one", "two"))
    assert one == two and len(one) == 1
    assert lake.read_csv_months(spark, str(tmp_path / "one"), SCHEMA, ["2024-02"]).count() == 0
    with pytest.raises(Exception, match="(?i)header|schema"):
        lake.read_csv_months(spark, str(tmp_path / "one"), SCHEMA.replace("open string", "first string")).collect()


def test_archives_run_again_give_the_same_bytes(spark, tmp_path):
    rows = month(spark)
    for name in ("one", "two"):
        found = lake.write_zips(rows.orderBy(F.rand()), ["symbol", "month"], "open_time_ms", ["open_time_ms", "close"], (tmp_path / name).as_uri()).collect()
        assert [(r.name, r["rows"]) for r in found] == [("a-2024-01", 31)]
    assert (tmp_path / "one/a-2024-01.zip").read_bytes() == (tmp_path / "two/a-2024-01.zip").read_bytes()
    assert archives.read_zip_csv(spark, str(tmp_path / "one/*.zip"), "open_time_ms long, close string").count() == 31
