"""Queries on the event log, stages, samples and pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import views as V
from quarry.operators import dag
from quarry.plans.named import register
from quarry.plans.oracle import with_
from quarry.session import table
from quarry.streaming import events as E

QUERIES, SQL, q = register()


_LOG = "WITH lo AS (SELECT DISTINCT event_id AS seq, user_id AS run, event_type AS stage, ts, value, (props->>'$.k')::INT AS k FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return E.log(table(spark, d, "events"))


@q("ob_trace_summary", f"{_LOG} SELECT stage, count(*) AS n, count(DISTINCT run) AS n_runs, count_if(k > 50) AS n_large, round(sum(value), 2) AS value FROM lo GROUP BY 1")
def ob_trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("n_runs"), F.count_if(F.col("k") > 50).alias("n_large"), F.round(F.sum("value"), 2).alias("value"))


@q("ob_spans", f"{_LOG} SELECT run, seq, stage, epoch_us(lead(ts) OVER (PARTITION BY run ORDER BY seq)) - epoch_us(ts) AS micros FROM lo")
def ob_spans(spark: SparkSession, d: str) -> DataFrame:
    return E.spans(_log(spark, d))


@q("ob_span_totals", f"{_LOG} SELECT run, count(*) AS n, round(sum(value), 2) AS cost FROM lo WHERE stage IN ('click', 'purchase') AND k >= 10 GROUP BY 1")
def ob_span_totals(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).filter("stage in ('click', 'purchase') and k >= 10").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"))


@q("ob_budget_breach", f"{_LOG} SELECT run, min(seq) AS seq, arg_min(spent, seq) AS spent FROM (SELECT run, seq, round(sum(value) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS spent FROM lo) WHERE spent > 500 GROUP BY 1")
def ob_budget_breach(spark: SparkSession, d: str) -> DataFrame:
    return E.breach(_log(spark, d), 500)


@q("ob_chain_ids", with_("fa", "SELECT sha1(string_agg(fact_id, '|' ORDER BY order_idx)) AS chain_id, count(*) AS depth FROM fa GROUP BY doc_id, (order_idx - 1) // 3"))
def ob_chain_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the chains of three facts that follow each other in a document; the last may be shorter."""
    f = V.facts(table(spark, d, "chunks")).groupBy("doc_id", F.expr("(order_idx - 1) div 3").alias("k")).agg(F.array_sort(F.collect_list(F.struct("order_idx", "fact_id"))).alias("s"))
    return f.select(F.sha1(F.array_join("s.fact_id", "|")).alias("chain_id"), F.size("s").alias("depth"))


@q("st_progress", f"{_LOG} SELECT run, seq, stage, round(cum_done::DOUBLE / total, 6) AS progress, CASE WHEN stage = 'error' THEN 'log' WHEN value IS NULL THEN 'progress' ELSE 'metric' END AS kind FROM (SELECT run, seq, stage, value, row_number() OVER (PARTITION BY run ORDER BY seq) AS cum_done, count(*) OVER (PARTITION BY run) AS total FROM lo)")
def st_progress(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a run as progress, log or metric event, with the share of the run's events up to it."""
    log = _log(spark, d)
    done = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    kind = F.when(F.col("stage") == "error", "log").when(F.col("value").isNull(), "progress").otherwise("metric")
    total = log.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    return log.withColumn("done", done).join(total, "run").select("run", "seq", "stage", F.round(F.col("done") / F.col("total"), 6).alias("progress"), kind.alias("kind"))


@q("st_latest_state", f"{_LOG} SELECT run, stage, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(k, seq) AS k FROM lo GROUP BY 1, 2")
def st_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(_log(spark, d))


@q("st_run_fold", f"{_LOG} SELECT run, max(seq) AS last_seq, arg_max(stage, seq) AS last_stage, count(*) AS n_events, round(sum(value), 2) AS cost, count_if(stage = 'error') AS n_errors FROM lo GROUP BY 1")
def st_run_fold(spark: SparkSession, d: str) -> DataFrame:
    return E.fold(_log(spark, d))


@q("st_replay", f"{_LOG} SELECT seq, run, stage FROM lo WHERE seq > 100 AND stage = 'error' ORDER BY seq LIMIT 50 OFFSET 10")
def st_replay(spark: SparkSession, d: str) -> DataFrame:
    return E.after(_log(spark, d), 100, F.col("stage") == "error").select("seq", "run", "stage").offset(10).limit(50)


@q("st_tumbling", f"{_LOG} SELECT time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, stage, count(*) AS n, round(sum(value), 2) AS value FROM lo GROUP BY 1, 2")
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(_log(spark, d))


@q("st_sessions", f"{_LOG} SELECT run, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, seq) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY run ORDER BY ts, seq) AS p FROM lo)) GROUP BY run, g")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(_log(spark, d))


_EDGES = "(VALUES " + ", ".join(f"('{a}', '{s}')" for s, deps in dag.STAGES.items() for a in deps) + ") v(a, b)"


@q("st_stage_dependents", f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(stage, dependent, hops) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.stage, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.dependent) SELECT stage, dependent, min(hops) AS hops FROM r GROUP BY 1, 2")
def st_stage_dependents(spark: SparkSession, d: str) -> DataFrame:
    return dag.downstream(spark, dag.STAGES)


@q("so_hash_sample", with_("qu", "SELECT q_id FROM qu ORDER BY md5(q_id || '42'), q_id LIMIT 25"))
def so_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 25 by the hash of id and seed."""
    return V.questions(table(spark, d, "questions")).orderBy(F.md5(F.concat("q_id", F.lit("42"))), "q_id").limit(25).select("q_id")


@q("so_union_distinct", with_("rk go", "SELECT q_id, chunk_id FROM rk WHERE rank = 1 UNION SELECT q_id, chunk_id FROM go"))
def so_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.ranked(table(spark, d, "retrievals")).filter("rank = 1").select("q_id", "chunk_id").unionByName(V.gold(table(spark, d, "questions"))).distinct()


@q("so_intersect", with_("rk go", "SELECT q_id, chunk_id FROM rk INTERSECT SELECT q_id, chunk_id FROM go"))
def so_intersect(spark: SparkSession, d: str) -> DataFrame:
    return V.ranked(table(spark, d, "retrievals")).select("q_id", "chunk_id").intersect(V.gold(table(spark, d, "questions")))


@q("so_except", with_("rk go", "SELECT q_id, chunk_id FROM go EXCEPT SELECT q_id, chunk_id FROM rk"))
def so_except(spark: SparkSession, d: str) -> DataFrame:
    return V.gold(table(spark, d, "questions")).select("q_id", "chunk_id").exceptAll(V.ranked(table(spark, d, "retrievals")).select("q_id", "chunk_id").distinct())
