"""Every registered market query runs on the smallest tables; those with SQL agree with DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

from quantloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(DATA))
    rows = found.collect()
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows_of(found.columns, rows) == rows_of(columns, cursor.fetchall())
    assert found.schema.fields


def test_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES
