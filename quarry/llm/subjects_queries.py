"""Queries on the subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.subjects import classify, fit_on
from quarry.session import table


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    subjects = sorted(r.subject.strip().lower() for r in table(spark, d, "subject_areas").filter("subject is not null").select("subject").distinct().collect())
    return classify(documents, fit_on(documents, table(spark, d, "subject_labels"), subjects))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).select("doc_id", "subject")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of the corpus: documents with a subject, and sentences about it, per subject."""
    return p9_shares(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(F.col("share") * F.col("sentences")), 3).alias("n_sentences"))


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_mix": p9_mix}
SQL: dict[str, str] = {}
