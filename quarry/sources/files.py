"""Sources and sinks: JSON lines, parquet, ORC, CSV, text and HTML blocks; write-once artifacts."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "q_id string, doc_id long, question string, answer string, hop_type string, gold_chunk_ids array<string>"
CHUNK = "chunk_id string, doc_id long, text string, char_start int, char_end int, page_start int, page_end int"
RETRIEVAL = "q_id string, retrieved_chunk_ids array<string>"
ANSWER = "q_id string, predicted_answer string, abstained boolean"
_FORMATS = {"jsonl": "json", "json": "json", "parquet": "parquet", "orc": "orc", "csv": "csv", "txt": "text"}


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reads by suffix. JSON lines and CSV need a schema, which is never inferred; a malformed line fails the read."""
    kind = _FORMATS[re.search(r"\.(\w+)/?$", path)[1].lower()]
    if kind in ("json", "csv") and not schema:
        raise ValueError(f"{path}: JSON and CSV are read with a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("json", "csv"):
        reader = reader.option("mode", "FAILFAST")
    return reader.option("header", True).format(kind).load(path) if kind == "csv" else reader.format(kind).load(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Writes by suffix; Spark's commit protocol makes the files appear together."""
    kind = _FORMATS[re.search(r"\.(\w+)/?$", path)[1].lower()]
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def write_artifact(df: DataFrame, folder: str, kind: str) -> str:
    """Writes a result once under a name made of its content, and gives its path; the same content is not written again."""
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    path = f"{folder}/{kind}-{h.n}-{h.s or 0}"
    try:
        df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("errorifexists").parquet(path)
    return path


def html_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, block_id, text, char_start: the text blocks of HTML pages, with offsets in their concatenation by blank lines."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?i)</?(p|div|h[1-6]|li|tr|br|table|ul|ol|section|article)[^>]*>", "\u0001")
    parts = F.filter(F.transform(F.split(F.regexp_replace(bare, "<[^>]+>", " "), "\u0001"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")
    rows = pages.select(page_id, parts.alias("b")).select(page_id, F.posexplode("b").alias("block_id", "text"), "b")
    before = F.aggregate(F.slice("b", F.lit(1), F.col("block_id")), F.lit(0), lambda s, x: s + F.length(x) + 2)
    return rows.select(page_id, "block_id", "text", before.alias("char_start"))
