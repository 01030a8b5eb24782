"""Every registered query on panels, and its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans import data_queries, outcome_queries, panel_queries, report_queries, score_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (panel_queries, data_queries, score_queries, outcome_queries, report_queries, stream_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
