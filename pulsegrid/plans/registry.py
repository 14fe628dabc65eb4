"""Named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Lake, with_tables


class Registry:
    """Collects a module's queries."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(function: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
            self.queries[name] = lambda spark, folder: function(Lake(spark, folder))
            if sql is not None:
                self.oracles[name] = with_tables(sql)
            return function

        return add
