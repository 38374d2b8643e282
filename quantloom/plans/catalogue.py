"""Registered queries of the market operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context, evidence, extra, further, lake, market, proofs, report, sequence, studies

FLAGSHIP = "breakout_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**market.QUERIES, **report.QUERIES, **sequence.QUERIES, **further.QUERIES, **studies.QUERIES, **extra.QUERIES, **evidence.QUERIES, **lake.QUERIES, **context.QUERIES}
SQL: dict[str, str] = {**market.SQL, **report.SQL, **sequence.SQL, **further.SQL, **studies.SQL, **extra.SQL, **evidence.SQL, **lake.SQL, **context.SQL, **proofs.PROOFS}
