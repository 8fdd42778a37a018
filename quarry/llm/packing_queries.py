"""Queries on containers filled with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.packing import pack_all
from quarry.session import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_sizes").select("pack_id", F.col("capacity_tokens").alias("capacity"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """pack_id, doc_id, piece, token_start, tokens, container for every pack size."""
    return pack_all(table(spark, d, "documents"), _sizes(spark, d))[0]


def p7_program(spark: SparkSession, d: str) -> DataFrame:
    """Per pack size: the program's lower bound, the containers of each stage, and by how much they exceed the bound."""
    where = pack_all(table(spark, d, "documents"), _sizes(spark, d))[1].select("pack_id", "stage", "base", "times", "bound").distinct()
    of = lambda s: F.sum(F.when(F.col("stage") == s, F.col("times")).otherwise(0))
    return where.groupBy("pack_id").agg(F.max("bound").alias("bound"), of("whole").alias("n_whole"), of("priced").alias("n_priced"), of("greedy").alias("n_greedy"), (F.sum("times") / F.max("bound") - 1).alias("gap"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per pack size: containers, tokens, the least number of containers that could hold them, and the share filled."""
    got = p7_containers(spark, d).groupBy("pack_id").agg(F.countDistinct("container").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    sized = got.join(table(spark, d, "pack_sizes").select("pack_id", "capacity_tokens").distinct(), "pack_id")
    return sized.select("pack_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_program": p7_program}
SQL: dict[str, str] = {}
