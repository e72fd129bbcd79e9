"""Registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register fn(table), where table(name) reads a table of the given folder."""

        def keep(fn: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
            if sql:
                self.oracle[name] = sql
            return fn

        return keep
