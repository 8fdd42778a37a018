"""Queries on references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.orphans import orphan_counts, retrieval_orphans
from quarry.session import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_orphans(*(table(spark, d, t) for t in ("retrievals", "questions", "eval_items", "chunks", "tombstones")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select(F.col("row_id").alias("ret_id"), "ref_field", "ref_key", "ref_state").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_found(spark, d), {"q_id": "questions", "retrieved_chunk_ids": "chunks"})


_CANON = r"regexp_replace(lower(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')), '(?s)^(.*_c)0*(.+)$', '\1\2')"
_ROWS = f"""
WITH c AS (SELECT {_CANON.format('chunk_id')} AS k, min(cached_at) AS since, bool_or(cached_at IS NULL) AS always FROM chunks GROUP BY 1),
t AS (SELECT {_CANON.format('chunk_id')} AS k, min(deleted_at) AS until FROM tombstones GROUP BY 1),
q AS (SELECT k, min(since) AS since, bool_or(always) AS always FROM (
  SELECT q_id AS k, created_at AS since, created_at IS NULL AS always FROM questions UNION ALL SELECT q_id, NULL, true FROM eval_items) GROUP BY 1),
r AS (SELECT DISTINCT ret_id, logged_at, 'retrieved_chunk_ids' AS ref_field, ref_key FROM (SELECT ret_id, logged_at, unnest(retrieved_chunk_ids) AS ref_key FROM retrievals) WHERE ref_key IS NOT NULL),
s AS (
  SELECT ret_id, logged_at, ref_field, ref_key, CASE WHEN t.until <= logged_at THEN 'deleted'
    WHEN c.k IS NOT NULL AND NOT c.always AND c.since > logged_at THEN 'late' WHEN c.k IS NULL AND t.k IS NULL THEN 'missing' END AS ref_state
  FROM r LEFT JOIN c ON c.k = {_CANON.format('r.ref_key')} LEFT JOIN t ON t.k = {_CANON.format('r.ref_key')}
  UNION ALL
  SELECT ret_id, logged_at, 'q_id', q_id, CASE WHEN q.k IS NOT NULL AND NOT q.always AND q.since > logged_at THEN 'late' WHEN q.k IS NULL THEN 'missing' END
  FROM (SELECT DISTINCT ret_id, logged_at, q_id FROM retrievals WHERE q_id IS NOT NULL) x LEFT JOIN q ON q.k = x.q_id)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
SQL = {
    "p2_found": _ROWS + "SELECT DISTINCT ret_id, ref_field, ref_key, ref_state FROM s WHERE ref_state IS NOT NULL",
    "p2_counts": _ROWS + """SELECT CASE ref_field WHEN 'q_id' THEN 'questions' ELSE 'chunks' END AS parent_table, strftime(logged_at, '%Y-%m') AS period, ref_state,
      count(*) AS n_refs, count(DISTINCT ret_id) AS n_rows FROM s WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3""",
}
