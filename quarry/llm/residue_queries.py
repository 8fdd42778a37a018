"""Queries on residue in questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.residue import residue
from quarry.session import table


def p6_residue(spark: SparkSession, d: str) -> DataFrame:
    parts = (("questions", "q_id", "question"), ("answers", "ans_id", "predicted_answer"))
    got = [residue(table(spark, d, t), i, c).select(F.lit(t).alias("src_table"), F.col("row_id").cast("string"), "residue", "share") for t, i, c in parts]
    return got[0].unionByName(got[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_residue(spark, d).select("src_table", "row_id", "residue").distinct()


QUERIES = {"p6_found": p6_found, "p6_residue": p6_residue}
SQL: dict[str, str] = {}
