"""Collects the queries of a module with the SQL that defines their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function (spark, sf_dir) -> DataFrame under a name."""

        def add(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.oracle[name] = sql
            return function

        return add
