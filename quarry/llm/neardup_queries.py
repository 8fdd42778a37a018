"""Queries on near-duplicate questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.neardup import near_duplicates, pairs
from quarry.operators.components import components
from quarry.session import cut, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "questions"), "q_id", "question")
    return pairs(members, links).toDF("q_id_a", "q_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per question id with a text: its set, its group and the number of other sets it is linked with."""
    members, links = near_duplicates(table(spark, d, "questions"), "q_id", "question")
    links = cut(links)
    n = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(members.select(F.col("sid").alias("node")).distinct(), links).toDF("sid", "group_id")
    return members.join(n, "sid", "left").join(groups, "sid").select(F.col("id").alias("q_id"), F.col("sid").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL = {
    "p5_found": r"""WITH q AS (SELECT DISTINCT q_id, question FROM questions WHERE question IS NOT NULL),
      w AS (SELECT DISTINCT q_id, question, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS w FROM q),
      n AS (SELECT q_id, question, count(*) AS n FROM w GROUP BY 1, 2),
      p AS (SELECT a.q_id AS qa, b.q_id AS qb, a.question AS ta, b.question AS tb, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.q_id < b.q_id GROUP BY 1, 2, 3, 4)
      SELECT DISTINCT qa AS q_id_a, qb AS q_id_b FROM p JOIN n x ON x.q_id = qa AND x.question = ta JOIN n y ON y.q_id = qb AND y.question = tb WHERE k >= 0.8 * (x.n + y.n - k)"""
}
