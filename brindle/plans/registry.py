"""A registry of queries and, where SQL can express them, of the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self._queries[f.__name__] = f
            if sql:
                self._sql[f.__name__] = sql
            return f

        return add

    def queries(self) -> dict:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
