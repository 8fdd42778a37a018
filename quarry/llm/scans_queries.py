"""Queries on noise in chunks of scanned pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.scans import Noise, repair
from quarry.session import stored, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Noise(table(spark, d, "chunks")).kinds()


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every chunk of scanned documents, marked or not: chunk_id, text.

    A document is scanned if any of its chunks was read by OCR or by what isn't known, or is noisy. What a chunk's repair needs is as bounded as its text.
    """
    chunks = table(spark, d, "chunks")
    noise = Noise(chunks)
    nothing = F.lit(None).cast("string")
    headed = noise.found.filter("kind = 'head'").join(noise.heads.withColumnRenamed("key", "a"), ["doc_id", "a"], "left_semi")
    marks = (
        headed.select("chunk_id", F.lit("head").alias("k"), "a", nothing.alias("b"))
        .unionByName(noise.pages.filter("form <> 'head'").select("chunk_id", F.lit("page").alias("k"), F.col("form").alias("a"), F.col("n").cast("string").alias("b")))
        .unionByName(noise.broken.select("chunk_id", F.lit("broken").alias("k"), "a", "b"))
        .unionByName(noise.misread.select("chunk_id", F.lit("word").alias("k"), F.col("w").alias("a"), F.col("better").alias("b")))
        .groupBy("chunk_id")
        .agg(F.collect_set(F.struct("k", "a", F.coalesce("b", F.lit("")).alias("b"))).alias("marks"))
    )

    @F.pandas_udf("string")
    def mend(text: pd.Series, marks: pd.Series) -> pd.Series:
        def one(t, ms):
            of = {k: [(m["a"], m["b"]) for m in (ms if ms is not None else ()) if m["k"] == k] for k in ("head", "page", "broken", "word")}
            return repair(t, {a for a, _ in of["head"]}, {(a, int(b)) for a, b in of["page"]}, set(of["broken"]), dict(of["word"]))

        return pd.Series([one(t, m) for t, m in zip(text, marks)])

    marks = stored(marks)
    noisy = chunks.select("chunk_id", "doc_id").join(marks.select("chunk_id"), "chunk_id", "left_semi").select("doc_id")
    scanned = stored(noisy.unionByName(chunks.filter("extractor is null or lower(extractor) like 'ocr%'").select("doc_id")).distinct())
    texts = chunks.filter("text is not null and chunk_id is not null").join(scanned, "doc_id", "left_semi").select("chunk_id", "text").join(marks, "chunk_id", "left").dropDuplicates(["chunk_id", "text"])
    return texts.select("chunk_id", mend("text", "marks").alias("text"))


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
SQL: dict[str, str] = {}
