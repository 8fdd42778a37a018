"""Queries on oversized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.pieces import latest_sizes, split_oversized
from quarry.operators.skew import hot_keys, skew_join
from quarry.session import table


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every oversized chunk. Texts within the smallest size are dropped before the join."""
    chunks, sizes = table(spark, d, "chunks"), latest_sizes(table(spark, d, "chunk_results"))
    long = chunks.select("chunk_id", "doc_id", "text").filter(F.length("text") > sizes.agg(F.min("chunk_size")).scalar())
    joined = skew_join(long, sizes, ["doc_id"], hot_keys(chunks, ["doc_id"]))
    over = joined.filter(F.length("text") > F.col("chunk_size")).dropDuplicates(["chunk_id", "text"])
    return split_oversized(over).drop("text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("n_pieces > 1").select("chunk_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": _pieces}
SQL = {
    "p1_found": """SELECT DISTINCT chunk_id FROM chunks JOIN
      (SELECT doc_id, arg_max(chunk_size, finished_at) AS chunk_size FROM chunk_results WHERE chunk_size IS NOT NULL GROUP BY 1) USING (doc_id) WHERE length(text) > chunk_size"""
}
