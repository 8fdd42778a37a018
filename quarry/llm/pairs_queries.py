"""Queries on broken question and answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.pairs import LANGUAGES, SAMPLE, SPOKEN, Model, defects, fit
from quarry.session import table


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """The answer log with the question of each row's q_id (null where there is none)."""
    asked = table(spark, d, "questions").select("q_id", "question").unionByName(table(spark, d, "eval_items").select("q_id", "question"))
    asked = asked.filter("question is not null").groupBy("q_id").agg(F.min("question").alias("question"))
    return table(spark, d, "answers").select("ans_id", "q_id", "predicted_answer", "abstained").join(asked, "q_id", "left")


def _sample(rows: DataFrame, question: str, answer: str, n: int) -> list[tuple[str, str]]:
    """At most n pairs, the first by a hash of their text."""
    use = rows.filter(F.col(question).isNotNull() & F.col(answer).isNotNull()).select(question, answer)
    return [tuple(r) for r in use.orderBy(F.xxhash64(question, answer), question, answer).limit(n).collect()]


def _spoken(documents: DataFrame) -> list[tuple[str, str]]:
    """At most SPOKEN documents with the language they are labelled with, the first by a hash of their id; some labels are wrong."""
    lang = F.substring(F.lower(F.trim("lang")), 1, 2)
    ids = documents.filter(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select("doc_id", lang.alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPOKEN)
    return [(r.text, r.lang) for r in documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "lang").collect() if r.text]


def fitted(spark: SparkSession, d: str) -> Model:
    answered = _logged(spark, d).filter(~F.coalesce("abstained", F.lit(False)))
    pairs = _sample(table(spark, d, "questions"), "question", "answer", SAMPLE // 2) + _sample(answered, "question", "predicted_answer", SAMPLE // 2)
    return fit(pairs, _spoken(table(spark, d, "documents")))


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    gold, log, model = table(spark, d, "questions"), _logged(spark, d), fitted(spark, d)
    a = defects(log, model, "ans_id", "question", "predicted_answer", "abstained")
    b = defects(gold, model, "q_id", "question", "answer")
    return a.select(F.lit("answers").alias("pair_table"), F.col("row_id").alias("pair_id"), "defect", "margin").unionByName(b.select(F.lit("questions").alias("pair_table"), F.col("row_id").alias("pair_id"), "defect", "margin"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_defects(spark, d).select("pair_table", "pair_id", "defect").distinct()


QUERIES = {"p4_found": p4_found, "p4_defects": p4_defects}
SQL: dict[str, str] = {}
