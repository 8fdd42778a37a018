"""Queries on held-out passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.leaks import leaks
from quarry.session import table


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '[\x{{00ad}}\x{{200b}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
SQL = {
    "p8_found": f"""WITH i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
      ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
      dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
}
