"""The driver contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


@pytest.mark.skipif(not Path(entry.SMOKE_DIR).exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() >= 0
