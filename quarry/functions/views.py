"""Derived tables that the operators work on: chunk rows, lines, facts, questions with their evidence, ranked retrievals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import chunk_key, extract_all, strip


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk id (in canonical form) with a text: the whole row cached last, the greatest on ties.

    Repeated rows count once; a corrected row replaces the earlier one as a whole. Tables without cached_at have no order
    but the row's own values.
    """
    at = F.coalesce("cached_at", F.lit("1970-01-01").cast("timestamp_ntz")) if "cached_at" in chunks.columns else F.lit(0)
    kept = ("doc_id", "text", "char_start", "char_end", "page_start", "page_end")
    known = [F.coalesce(c, F.lit(-1).cast(chunks.schema[c].dataType)).alias(c) if c != "text" else F.col(c) for c in kept]
    last = chunks.filter("text is not null").groupBy(chunk_key(F.trim(F.lower("chunk_id"))).alias("chunk_id")).agg(F.max(F.struct(at.alias("at"), *known)).alias("r"))
    return last.select("chunk_id", *(F.nullif(f"r.{c}", F.lit(-1).cast(chunks.schema[c].dataType)).alias(c) if c != "text" else F.col("r.text") for c in kept))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_idx, text, n_chars, char_start, page_no: lines of documents with running offsets; three lines make a page.

    Lengths are taken before the window, so a query that doesn't ask for the text doesn't shuffle it.
    """
    rows = documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).withColumn("n_chars", F.length("text"))
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "line_idx", "text", "n_chars", F.coalesce(F.sum(F.col("n_chars") + 1).over(before), F.lit(0)).alias("char_start"), (F.floor(F.col("line_idx") / 3) + 1).cast("int").alias("page_no"))


def facts(chunks: DataFrame, least: int = 30) -> DataFrame:
    """Sentences of chunks as facts: fact_id `{doc}_F%06d` by order in the document, chunk_id, doc_id, text, page_start, order_idx."""
    s = chunk_rows(chunks).select("chunk_id", "doc_id", "page_start", F.posexplode(F.transform(extract_all(F.col("text"), "[^.!?]+(?:[.!?]+|$)"), strip)).alias("i", "text")).filter(F.length("text") >= least)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("chunk_id"), "chunk_id", "i"))
    return s.withColumn("order_idx", order).select(F.format_string("%d_F%06d", "doc_id", "order_idx").alias("fact_id"), "chunk_id", "doc_id", "text", "page_start", "order_idx")


def questions(table: DataFrame) -> DataFrame:
    """One row per question id."""
    return table.groupBy("q_id").agg(F.min("doc_id").alias("doc_id"), F.min("question").alias("question"), F.min("answer").alias("answer"), F.coalesce(F.min("hop_type"), F.lit("single")).alias("hop_type"), F.max("gold_chunk_ids").alias("gold_chunk_ids"))


def gold(table: DataFrame) -> DataFrame:
    """q_id, chunk_id (canonical): the distinct evidence chunks of each question."""
    return questions(table).select("q_id", F.explode("gold_chunk_ids").alias("g")).filter("g is not null").select("q_id", chunk_key(F.trim(F.lower("g"))).alias("chunk_id")).distinct()


def retrieval_rows(table: DataFrame) -> DataFrame:
    """One row per retrieval with a question: ret_id, q_id, mode, top_k, ids (canonical, first place of each kept)."""
    ids = F.array_distinct(F.transform(F.filter("retrieved_chunk_ids", lambda x: x.isNotNull()), lambda x: chunk_key(F.trim(F.lower(x)))))
    rows = table.filter("q_id is not null and retrieved_chunk_ids is not null").select("ret_id", "q_id", F.coalesce(F.lower(F.trim("search_mode")), F.lit("unknown")).alias("mode"), "top_k", ids.alias("ids"))
    return rows.groupBy("ret_id").agg(F.min("q_id").alias("q_id"), F.min("mode").alias("mode"), F.min("top_k").alias("top_k"), F.max("ids").alias("ids"))


def ranked(table: DataFrame) -> DataFrame:
    """ret_id, q_id, mode, rank (from 1), chunk_id."""
    return retrieval_rows(table).select("ret_id", "q_id", "mode", F.posexplode("ids").alias("p", "chunk_id")).select("ret_id", "q_id", "mode", (F.col("p") + 1).alias("rank"), "chunk_id")
