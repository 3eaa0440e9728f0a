"""A book of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with the SQL that gives the same rows."""

        def keep(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.ORACLES[f.__name__] = sql
            return f

        return keep


def unit_sql(x: str) -> str:
    """functions.scalar.hash_unit in SQL."""
    return f"((({x}) * 1103515245 + 12345) % 2147483648) / CAST(2147483648 AS DOUBLE)"


def mix_sql(x: str) -> str:
    """functions.scalar.hash_mix in SQL."""
    y = f"((({x}) * 1103515245 + 12345) % 2147483648)"
    return f"(({y} * {y} + 7 * {y}) % 2147483647) / CAST(2147483647 AS DOUBLE)"
