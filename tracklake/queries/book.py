"""Where the query modules write down their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklake.fixtures import view, with_views


class Inputs:
    """The fixture views and tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, make: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
        """A query, made from the inputs, and DuckDB SQL for it over the given tables and the fixture views."""
        self.queries[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if sql:
            self.oracles[name] = with_views(sql)
