"""Named queries of a module, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def register() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """QUERIES, SQL and the decorator q(name, sql) that fills them."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def q(name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return keep

    return queries, sqls, q
