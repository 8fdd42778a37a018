"""Collects the named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import event_queries, filter_queries, graph_queries, mapping_queries, orphan_queries, retrieval_queries, stats_queries, text_queries

_PARTS = (orphan_queries, text_queries, filter_queries, retrieval_queries, graph_queries, stats_queries, event_queries, mapping_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_queries.ev_leaderboard(spark, d)
