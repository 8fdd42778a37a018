"""Stages with dependencies: order, closure, and a runner over lazily built DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# The stages of an evaluation run and what each waits for.
STAGES = {
    "profile": (), "ingest": ("profile",), "chunk": ("ingest",), "extract": ("chunk",), "clean": ("extract",), "graph": ("clean",), "sample": ("graph",), "qagen": ("sample",), "verify": ("qagen",), "gt_dataset": ("verify",),
    "bm25_index": ("chunk",), "vector_index": ("chunk",), "fusion": ("bm25_index", "vector_index"), "rerank_warmup": ("fusion",),
    "sweep": ("gt_dataset", "fusion", "rerank_warmup"), "leaderboard": ("sweep",), "select_config": ("leaderboard",), "final_eval": ("select_config",), "report": ("final_eval",),
}


def order(stages: dict[str, tuple[str, ...]]) -> list[str]:
    """A topological order, by level then name. Raises ValueError on unknown dependencies and cycles."""
    for s, deps in stages.items():
        if missing := [x for x in deps if x not in stages]:
            raise ValueError(f"{s} waits for unknown {missing}")
    done: list[str] = []
    while len(done) < len(stages):
        ready = sorted(s for s in stages if s not in done and all(x in done for x in stages[s]))
        if not ready:
            raise ValueError(f"cycle among {sorted(set(stages) - set(done))}")
        done += ready
    return done


def downstream(spark: SparkSession, stages: dict[str, tuple[str, ...]]) -> DataFrame:
    """stage, dependent, hops: the transitive dependents of every stage, by a recursive query."""
    edges = [(d, s) for s, deps in stages.items() for d in deps]
    spark.createDataFrame(edges, "a string, b string").createOrReplaceTempView("__stage_edges")
    return spark.sql("""WITH RECURSIVE r(stage, dependent, hops) AS (SELECT a, b, 1 FROM __stage_edges UNION ALL SELECT r.stage, e.b, r.hops + 1 FROM r JOIN __stage_edges e ON e.a = r.dependent)
      SELECT stage, dependent, min(hops) AS hops FROM r GROUP BY 1, 2""")


def execute(spark: SparkSession, stages: dict[str, tuple[str, ...]], build: dict[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]], folder: str, completed: frozenset[str] = frozenset(), errors: dict[str, Exception] | None = None) -> dict[str, str]:
    """Runs stages in order; each writes a table at folder/stage that later ones read. Status of each: completed, failed or skipped.

    A failed stage skips all that wait for it, and its error is logged and put into `errors`. `completed` stages are read from their tables instead of run again.
    """
    status: dict[str, str] = {}
    tables: dict[str, DataFrame] = {}
    for s in order(stages):
        if any(status[x] != "completed" for x in stages[s]):
            status[s] = "skipped"
            continue
        try:
            if s not in completed:
                build[s](spark, {x: tables[x] for x in stages[s]}).write.mode("overwrite").parquet(f"{folder}/{s}")
            tables[s] = spark.read.parquet(f"{folder}/{s}")
            status[s] = "completed"
        except Exception as e:  # noqa: BLE001
            log.exception("stage %s failed", s)
            status[s] = "failed"
            if errors is not None:
                errors[s] = e
    return status
