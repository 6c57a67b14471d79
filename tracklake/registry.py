"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklake.queries import cues, intervals, quality, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (intervals, quality, cues, tracks):
    QUERIES |= module.book.queries
    ORACLES |= module.book.oracles
