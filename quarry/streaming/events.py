"""The event log as a batch table and as a stream: latest states, run folds, windows, sessions, budget breaches.

The log's own order is `seq`; an event is late or repeated if its seq is not above the last one seen for its run. The
batch functions take any DataFrame; the streaming ones give the same rows once a stream of the same events has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def log(events: DataFrame) -> DataFrame:
    """seq, run, stage, ts, value, k: the events table read as a run log; repeated seqs count once."""
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k")).dropDuplicates(["run", "seq"])


def latest(rows: DataFrame) -> DataFrame:
    """run, stage, seq, value, k of the last event of each run and stage."""
    return rows.groupBy("run", "stage").agg(F.max(F.struct("seq", "value", "k")).alias("x")).select("run", "stage", "x.*")


def fold(rows: DataFrame) -> DataFrame:
    """One row per run: last seq, last stage, events, cost, errors."""
    return rows.groupBy("run").agg(F.max("seq").alias("last_seq"), F.max_by("stage", "seq").alias("last_stage"), F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("cost"), F.count_if(F.col("stage") == "error").alias("n_errors"))


def breach(rows: DataFrame, cap: float) -> DataFrame:
    """run, seq, spent: the first event at which a run's running cost exceeds the cap."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = rows.withColumn("spent", F.round(F.sum("value").over(w), 2)).filter(F.col("spent") > cap)
    return c.groupBy("run").agg(F.min(F.struct("seq", "spent")).alias("x")).select("run", "x.*")


def spans(rows: DataFrame) -> DataFrame:
    """run, seq, stage, seconds until the run's next event (null for the last)."""
    w = Window.partitionBy("run").orderBy("seq")
    return rows.select("run", "seq", "stage", (F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


def tumbling(rows: DataFrame, width: str = "6 hours") -> DataFrame:
    """start, stage, n, value per window of time."""
    return rows.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "stage", "n", "value")


def sessions(rows: DataFrame, gap: str = "12 hours") -> DataFrame:
    """run, start, n: bursts of a run's events without a pause of `gap`."""
    return rows.groupBy("run", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("run", F.col("w.start").alias("start"), "n")


def read_stream(spark, path: str, schema: str = EVENT, files_per_batch: int = 1) -> DataFrame:
    """A stream of parquet files of events, some per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_tumbling(stream: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """tumbling() over a stream: repeated events are dropped within the watermark, later ones than `late` ignored."""
    kept = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_id"])
    return kept.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "stage", "n", "value")


def stream_fold(stream: DataFrame) -> DataFrame:
    """fold() over a stream, by state per run: events whose seq is not above the last are ignored. Update mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, stage, n, cost, errors = state.get if state.exists else (-1, "", 0, 0.0, 0)
        p = pd.concat(list(batches)).sort_values("event_id").drop_duplicates("event_id")
        p = p[p.event_id > last]
        if len(p):
            last, stage = int(p.event_id.iloc[-1]), str(p.event_type.iloc[-1])
            n, cost, errors = n + len(p), cost + float(p.value.sum()), errors + int((p.event_type == "error").sum())
        state.update((last, stage, n, cost, errors))
        yield pd.DataFrame({"run": [key[0]], "last_seq": [last], "last_stage": [stage], "n_events": [n], "cost": [round(cost, 2)], "n_errors": [errors]})

    out = "run long, last_seq long, last_stage string, n_events long, cost double, n_errors long"
    return stream.groupBy("user_id").applyInPandasWithState(step, out, "last long, stage string, n long, cost double, errors long", "update", "NoTimeout")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str):
    """Keeps the latest state of each run and stage as a table at `path`, by foreachBatch; a replayed batch changes nothing.

    Batch n merges with the table v{n - 1} and writes v{n}, whole, so the greatest complete version is the state and a lost
    executor or a restart finds one. Only the last two versions stay, the one before for a batch that is run again. A batch
    rewrites all states, a row per run and stage, which suits logs far larger than their states.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(log(batch))
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/v{number - 1}")).groupBy("run", "stage").agg(F.max(F.struct("seq", "value", "k")).alias("x")).select("run", "stage", "x.*")
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(rows: DataFrame, seq: int, stage: Column | None = None) -> DataFrame:
    """Replay: events after seq, of a stage where given, in order."""
    r = rows.filter(F.col("seq") > seq)
    return (r.filter(stage) if stage is not None else r).orderBy("seq")
