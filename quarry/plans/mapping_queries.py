"""Queries on mapping evidence, contexts, reports and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.functions import views as V
from quarry.operators import alignment as A
from quarry.operators import graph as G
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators.components import components
from quarry.plans.filter_queries import _CONTENT
from quarry.plans.graph_queries import _FA, _PAIRS, _SCHED
from quarry.plans.named import register
from quarry.plans.oracle import tok, with_
from quarry.plans.retrieval_queries import _OWN, _SPANS, _bm25, _chunks, _overlaps, _rel, _rel_sql
from quarry.plans.stats_queries import _average_rank, _corr, pearson
from quarry.session import table

QUERIES, SQL, q = register()


@q("mx_exact_alignment", with_("fa", "SELECT fact_id, instr(d.text, fa.text) - 1 AS char_start, instr(d.text, fa.text) - 1 + length(fa.text) AS char_end FROM fa JOIN documents d USING (doc_id) WHERE instr(d.text, fa.text) > 0"))
def mx_exact_alignment(spark: SparkSession, d: str) -> DataFrame:
    return A.exact(V.facts(table(spark, d, "chunks")), table(spark, d, "documents"))


@q("mx_fuzzy_alignment")
def mx_fuzzy_alignment(spark: SparkSession, d: str) -> DataFrame:
    return A.fuzzy(V.facts(table(spark, d, "chunks")), table(spark, d, "documents"))


@q("mx_multiset_overlap", with_("go ch qu", f"""SELECT q_id, chunk_id, round(sum(least(x, coalesce(y, 0)))::DOUBLE / sum(x), 6) AS recall FROM (SELECT go.q_id, go.chunk_id, t, count(*) AS x FROM go JOIN (SELECT q_id, unnest({tok('answer')}) AS t FROM qu) USING (q_id) GROUP BY ALL) a
  JOIN ch c0 USING (chunk_id) LEFT JOIN (SELECT chunk_id, t, count(*) AS y FROM (SELECT chunk_id, unnest({tok('text')}) AS t FROM ch) GROUP BY ALL) b USING (chunk_id, t) GROUP BY 1, 2"""))
def mx_multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of the gold answer's tokens, repeats counted, that each evidence chunk covers."""
    t = table(spark, d, "questions")
    rows = V.gold(t).join(V.questions(t).select("q_id", T.tokens(F.col("answer")).alias("a")), "q_id").join(_chunks(spark, d).select("chunk_id", T.tokens(F.col("text")).alias("c")), "chunk_id").filter(F.size("a") > 0)
    return rows.select("q_id", "chunk_id", F.round(A.multiset_overlap(F.col("a"), F.col("c")) / F.size("a"), 6).alias("recall"))


@q("mx_token_offsets", with_("qu", r"""SELECT q_id, i::INT AS idx, token, (length(lead) + coalesce(list_sum(list_transform(t[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0))::INT AS char_start FROM (
  SELECT q_id, unnest(t) AS token, unnest(range(len(t))) AS i, t, s, lead FROM (SELECT q_id, regexp_extract_all(question, '\S+') AS t, regexp_extract_all(regexp_replace(question, '^\s+', ''), '\s+') AS s, regexp_extract(question, '^\s+') AS lead FROM qu WHERE question IS NOT NULL))"""))
def mx_token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions with their places in the text."""
    u = V.questions(table(spark, d, "questions")).filter("question is not null")
    rows = u.select("q_id", T.extract_all(F.col("question"), r"\S+").alias("t"), T.extract_all(F.regexp_replace("question", r"^\s+", ""), r"\s+").alias("s"), F.length(F.regexp_extract("question", r"^\s+", 0)).alias("lead"))
    total = lambda a: F.aggregate(F.slice(a, F.lit(1), F.col("idx")), F.lit(0), lambda s, x: s + F.length(x))
    return rows.select("q_id", "t", "s", "lead", F.posexplode("t").alias("idx", "token")).select("q_id", "idx", "token", (F.col("lead") + total(F.col("t")) + total(F.col("s"))).alias("char_start"))


@q("mx_expected_chunks", with_("ch", "").rstrip() + f",\n{_SPANS}\nSELECT DISTINCT span_id, chunk_id FROM (SELECT span_id, chunk_id FROM ov WHERE s IS NOT NULL AND e IS NOT NULL AND char_start IS NOT NULL AND share >= 0.5 UNION ALL SELECT span_id, regexp_replace(trim(lower(span_id)), '_c0*([0-9]+)$', '_c\\1') FROM sp WHERE span_id IS NOT NULL)")
def mx_expected_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a span may be found in: those it overlaps by half and the one it names."""
    named = table(spark, d, "chunk_results").select(F.explode("chunks.chunk_id").alias("span_id")).filter("span_id is not null")
    return _overlaps(spark, d).filter("share >= 0.5").select("span_id", "chunk_id").unionByName(named.select("span_id", T.chunk_key(F.trim(F.lower("span_id"))).alias("chunk_id"))).distinct()


@q("mx_result_ranges", "SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(chunks, lambda c: c.char_start IS NOT NULL AND c.char_end IS NOT NULL), lambda c: [c.char_start, c.char_end]))) AS ranges FROM (SELECT doc_id, max(chunks) AS chunks FROM chunk_results GROUP BY 1)")
def mx_result_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The complete ranges of a document's result, rolled up."""
    whole = F.filter("chunks", lambda c: c["char_start"].isNotNull() & c["char_end"].isNotNull())
    r = table(spark, d, "chunk_results").groupBy("doc_id").agg(F.max("chunks").alias("chunks"))
    return r.select("doc_id", F.array_sort(F.array_distinct(F.transform(whole, lambda c: F.array(c["char_start"], c["char_end"])))).alias("ranges"))


@q("ev_span_scores", _rel_sql("SELECT mode, round(avg(CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE len(rel)::DOUBLE / n_gold END), 6) AS fsr, round(avg(CASE WHEN n_gold > 0 THEN len(rel)::DOUBLE / n END), 6) AS fsp, count_if(n_gold = 0) AS n_without FROM rl GROUP BY 1"))
def ev_span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Span recall (1 where nothing is required) and span precision (not counted there), by mode."""
    n = F.col("n_gold")
    return _rel(spark, d).groupBy("mode").agg(F.round(F.avg(F.when(n == 0, 1.0).otherwise(F.size("rel") / F.greatest(n, F.lit(1)))), 6).alias("fsr"), F.round(F.avg(F.when(n > 0, F.size("rel") / F.col("n"))), 6).alias("fsp"), F.count_if(n == 0).alias("n_without"))


@q("ag_rank_agreement", _rel_sql("SELECT count(*) AS n, " + _corr("a", "b") + " AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM (SELECT q_id, round(avg((recall + precision + precision_rw) / 3), 9) AS x, round(avg(ndcg), 9) AS y FROM am WHERE k = 5 GROUP BY 1))", True))
def ag_rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a composite of three metrics with another metric, per question."""
    m = M.at_all(_rel(spark, d), (5,)).groupBy("q_id").agg(F.round(F.avg((F.col("recall") + F.col("precision") + F.col("precision_rw")) / 3), 9).alias("x"), F.round(F.avg("ndcg"), 9).alias("y"))
    return m.join(_average_rank(m, "x"), "x").join(_average_rank(m, "y"), "y").agg(F.count(F.lit(1)).alias("n"), pearson("rank_x", "rank_y").alias("rho"))


@q("ev_bm25_report", with_("ch qu go", "").rstrip() + f",\n{_OWN},\n{_bm25('ow', 'ch', 'doc_id')},\ntp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10),\nrs AS (SELECT g.q_id, count(*) AS n, count_if(coalesce(rank <= 5, false)) AS h5, count(rank) AS h10, min(rank) AS f FROM go g LEFT JOIN tp USING (q_id, chunk_id) GROUP BY 1)\nSELECT count(*) AS n, round(avg(h5::DOUBLE / n), 6) AS recall_5, round(avg(h10::DOUBLE / n), 6) AS recall_10, round(avg((h10 = n)::INT), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM rs")
def ev_bm25_report(spark: SparkSession, d: str) -> DataFrame:
    """BM25 within documents against the gold chunks."""
    t = table(spark, d, "questions")
    own = V.questions(t).filter("question is not null").select("q_id", "doc_id", F.col("question").alias("text"))
    top = R.top_k(R.bm25(own, _chunks(spark, d), ("doc_id",)), 10)
    r = V.gold(t).join(top, ["q_id", "chunk_id"], "left").groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("h5"), F.count("rank").alias("h10"), F.min("rank").alias("f"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("h5") / F.col("n")), 6).alias("recall_5"), F.round(F.avg(F.col("h10") / F.col("n")), 6).alias("recall_10"), F.round(F.avg((F.col("h10") == F.col("n")).cast("int")), 6).alias("hit_10"), F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr"))


@q("ev_twin_report", with_("qu", "SELECT len(gold_chunk_ids) >= 2 AS is_twin, count(*) AS n, count_if(abstained) AS n_abstained, round(avg(abstained::INT), 6) AS rate, avg(abstained::INT) >= 0.7::DOUBLE AS passes FROM qu JOIN (SELECT q_id, bool_or(coalesce(abstained, false)) AS abstained FROM answers GROUP BY 1) USING (q_id) WHERE gold_chunk_ids IS NOT NULL GROUP BY 1"))
def ev_twin_report(spark: SparkSession, d: str) -> DataFrame:
    """How often questions are abstained from, by whether a twin without one piece of evidence can be made, against 70 percent."""
    a = table(spark, d, "answers").groupBy("q_id").agg(F.bool_or(F.coalesce("abstained", F.lit(False))).alias("abstained"))
    r = V.questions(table(spark, d, "questions")).filter("gold_chunk_ids is not null").join(a, "q_id")
    rate = F.avg(F.col("abstained").cast("int"))
    return r.groupBy((F.size("gold_chunk_ids") >= 2).alias("is_twin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"), F.round(rate, 6).alias("rate"), (rate >= 0.7).alias("passes"))


@q("ag_label_audit", "SELECT coalesce(annotator, 'none') AS annotator, count(*) AS n, count(subject) AS n_filled, count_if(coalesce(known, false)) AS n_known, round(count_if(coalesce(known, false))::DOUBLE / nullif(count(subject), 0), 6) AS rate FROM (SELECT l.*, lower(trim(l.subject)) IN (SELECT subject FROM subject_areas) AS known FROM subject_labels l) GROUP BY 1")
def ag_label_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels per annotator: given, filled, and naming a known area."""
    areas = F.broadcast(table(spark, d, "subject_areas").select(F.col("subject").alias("s"), F.lit(True).alias("known")).distinct())
    l = table(spark, d, "subject_labels").withColumn("s", F.lower(F.trim("subject"))).join(areas, "s", "left")
    return l.groupBy(F.coalesce("annotator", F.lit("none")).alias("annotator")).agg(F.count(F.lit(1)).alias("n"), F.count("subject").alias("n_filled"), F.count("known").alias("n_known"), F.round(F.count("known") / F.nullif(F.count("subject"), F.lit(0)), 6).alias("rate"))


@q("gr_chain_edges", f"{_FA},\n{_PAIRS},\n{_SCHED}\nSELECT a.fact_id AS fact_a, b.fact_id AS fact_b, coalesce(s2.score, 0.0) AS score FROM fa a JOIN fa b ON a.doc_id = b.doc_id AND b.order_idx = a.order_idx + 1 LEFT JOIN s2 ON s2.fact_a = a.fact_id AND s2.fact_b = b.fact_id")
def gr_chain_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the chain of each document's facts in reading order; a missing edge scores 0."""
    f = V.facts(table(spark, d, "chunks"))
    chain = f.withColumn("fact_b", F.lead("fact_id").over(Window.partitionBy("doc_id").orderBy("order_idx"))).filter("fact_b is not null").select(F.col("fact_id").alias("fact_a"), "fact_b")
    return chain.join(G.schedule(G.neighbour_pairs(f)).select("fact_a", "fact_b", "score"), ["fact_a", "fact_b"], "left").fillna(0.0, ["score"])


@q("gr_sampled_pairs")
def gr_sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs taken in reading order, each fact used once: sequential, so one document is one Arrow group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for r in p.sort_values(["fact_a", "distance"]).itertuples():
            if r.fact_a not in used and r.fact_b not in used:
                used |= {r.fact_a, r.fact_b}
                out.append((r.doc_id, r.fact_a, r.fact_b))
        return pd.DataFrame(out, columns=["doc_id", "fact_a", "fact_b"])

    p = G.neighbour_pairs(V.facts(table(spark, d, "chunks"))).filter("shared >= 0.2").select("doc_id", "fact_a", "fact_b", "distance")
    return p.groupBy("doc_id").applyInPandas(run, "doc_id long, fact_a string, fact_b string")


@q("gr_vector_groups")
def gr_vector_groups(spark: SparkSession, d: str) -> DataFrame:
    """Single-link groups of all vectors by cosine 0.3 and more; one without links is its own group. Repeated ids count once."""
    e = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return components(e.select(F.col("vec_id").alias("node")), R.alike(e, 0.3)).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@q("gr_kmeans_groups")
def gr_kmeans_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters of the vectors by k-means, and how pure they are in the vectors' own labels."""
    e = table(spark, d, "embeddings").filter("vec_id is not null").dropDuplicates(["vec_id"])
    c = R.vector_clusters(e, 10).join(e.select("vec_id", "label"), "vec_id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("cluster").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("purity"))


@q("gr_vector_distractors", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, a.label AS own, b.label,
  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 20),
  one AS (SELECT min_by(query_id, (-score, query_id)) AS query_id, vec_id, max(score) AS score FROM nn WHERE score >= 0.2::DOUBLE AND own IS DISTINCT FROM label GROUP BY vec_id)
  SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM one) WHERE r <= 2""")
def gr_vector_distractors(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth vector the two nearest of another label that no other one has."""
    e = table(spark, d, "embeddings")
    return R.distractors(R.nearest(e, e.filter("vec_id % 20 = 0"), 20), e.select("vec_id", F.col("label").alias("group")), 0.2)


_LEAD = "substr(lower(t), 1, 60)"


_ALONE = rf"""CASE WHEN t = '' OR NOT regexp_matches(t, '^[^A-Za-z]*[A-Z]') OR {"regexp_matches(t, '" + P.DEICTIC_OPENER + "')"} THEN 0 WHEN regexp_matches(t, '^[A-Z][a-zA-Z].*\b(is|are|was|were|defines?|refers? to|involves?|requires?|specifies?|consists?\s+of|represents?|enables?|allows?)\b') AND NOT regexp_matches({_LEAD}, '\bis\s+(like|similar to|also\b|part of)') THEN CASE WHEN t LIKE '%.' THEN 4 ELSE 3 END
  WHEN regexp_matches(t, '^(A|An|The)\s+[A-Za-z]') AND t LIKE '%.' THEN 3 WHEN t LIKE '%.' THEN 2 ELSE 1 END"""


@q("fi_fallback_score", with_("fa", rf"""SELECT score, count(*) AS n FROM (SELECT {_ALONE} AS score FROM (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM fa)) GROUP BY 1"""))
def fi_fallback_score(spark: SparkSession, d: str) -> DataFrame:
    """How well a fact stands alone, 0 to 4."""
    return V.facts(table(spark, d, "chunks")).groupBy(_alone(F.col("text")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def _alone(text: Column) -> Column:
    t = T.squeeze(text)
    ends, lead = t.endswith("."), F.substring(F.lower(t), 1, 60)
    defines = t.rlike(r"^[A-Z][a-zA-Z].*\b(is|are|was|were|defines?|refers? to|involves?|requires?|specifies?|consists?\s+of|represents?|enables?|allows?)\b") & ~lead.rlike(r"\bis\s+(like|similar to|also\b|part of)")
    return F.when((t == "") | ~t.rlike("^[^A-Za-z]*[A-Z]") | t.rlike(P.DEICTIC_OPENER), 0).when(defines, F.when(ends, 4).otherwise(3)).when(t.rlike(r"^(A|An|The)\s+[A-Za-z]") & ends, 3).when(ends, 2).otherwise(1)


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{r}'" for r, p in P.ROLES) + " ELSE 'definition' END"
_RANK = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in G.ROLE_RANK.items()) + " ELSE 6 END"


@q("gr_single_chains", with_("fa", rf"""SELECT doc_id, fact_id, place FROM (SELECT doc_id, fact_id, row_number() OVER (PARTITION BY doc_id ORDER BY again, s, page, r, l, fact_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY s, page, r, l, fact_id) > 1 AS again FROM (
  SELECT doc_id, fact_id, -({_ALONE}) AS s, coalesce(page_start, 0) AS page, {_RANK} AS r, length(text) AS l FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, {_ROLE} AS role FROM fa) WHERE role <> 'example' AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) BETWEEN 6 AND 60))) WHERE place <= 12"""))
def gr_single_chains(spark: SparkSession, d: str) -> DataFrame:
    """Up to twelve facts of each document for questions of one hop: one a page, then the next best."""
    return G.single_chains(V.facts(table(spark, d, "chunks")), _alone(F.col("text")))


_GENERIC = r"(?i)\b(elaborates?\s+on|provides?\s+(?:additional\s+)?context|related\s+to|same\s+(?:concept|topic|subject|idea|thing)|similar\s+(?:concept|topic|subject|idea)|further\s+(?:describes|explains|discusses)|additional\s+information|more\s+specific\s+description)\b"


@q("fi_generic_claims", with_("qu", f"SELECT q_id, length(a) < 20 OR regexp_matches(a, '{_GENERIC}') AS generic FROM (SELECT q_id, trim(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g')) AS a FROM qu)"))
def fi_generic_claims(spark: SparkSession, d: str) -> DataFrame:
    a = T.squeeze(F.coalesce("answer", F.lit("")))
    return V.questions(table(spark, d, "questions")).select("q_id", ((F.length(a) < 20) | a.rlike(_GENERIC)).alias("generic"))


@q("fi_best_quotes", with_("fa qu", f"SELECT q_id, max_by(fa.text, (k, -length(fa.text), fa.fact_id)) AS quote FROM (SELECT qu.q_id, fa.fact_id, fa.text, len(list_intersect(list_distinct({tok('fa.text')}), list_distinct({tok('qu.answer')}))) AS k FROM qu JOIN fa USING (doc_id) WHERE answer IS NOT NULL) JOIN fa USING (fact_id) GROUP BY 1"))
def fi_best_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of a question's document that shares most with its answer, the shorter on ties."""
    u = V.questions(table(spark, d, "questions")).filter("answer is not null").select("q_id", "doc_id", F.array_distinct(T.tokens(F.col("answer"))).alias("at"))
    f = V.facts(table(spark, d, "chunks")).select("doc_id", "fact_id", "text", F.array_distinct(T.tokens(F.col("text"))).alias("ft"))
    k = F.size(F.array_intersect("at", "ft"))
    return u.join(f, "doc_id").groupBy("q_id").agg(F.max_by("text", F.struct(k.alias("k"), (-F.length("text")).alias("l"), F.col("fact_id"))).alias("quote"))


@q("fi_assumptions", with_("qu go ch", f"SELECT q_id, round(len(list_filter(c, lambda x: list_contains(e, x)))::DOUBLE / greatest(1, len(c)), 6) AS covered FROM (SELECT qu.q_id, min({_CONTENT.format('qu.question')}) AS c, list_distinct(flatten(list({_CONTENT.format('ch.text')}))) AS e FROM qu JOIN go USING (q_id) JOIN ch USING (chunk_id) WHERE qu.question IS NOT NULL GROUP BY 1)"))
def fi_assumptions(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's content words that its evidence has."""
    t = table(spark, d, "questions")
    e = V.gold(t).join(_chunks(spark, d).select("chunk_id", T.content_tokens(F.col("text")).alias("c")), "chunk_id").groupBy("q_id").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("e"))
    c = T.content_tokens(F.col("question"))
    return V.questions(t).filter("question is not null").join(e, "q_id").select("q_id", F.round(F.size(F.array_intersect(c, F.col("e"))) / F.greatest(F.lit(1), F.size(c)), 6).alias("covered"))


@q("mx_single_pairs", with_("fa qu", "SELECT q_id, min(fact_id) AS fact_id FROM qu JOIN fa ON fa.doc_id = qu.doc_id AND contains(fa.text, regexp_extract(qu.answer, '[0-9]+(?:\\.[0-9]+)?')) WHERE regexp_matches(qu.answer, '[0-9]') GROUP BY 1"))
def mx_single_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose answer's first number stands in a single fact of their document."""
    u = V.questions(table(spark, d, "questions")).filter(F.col("answer").rlike("[0-9]")).select("q_id", "doc_id", F.regexp_extract("answer", r"[0-9]+(?:\.[0-9]+)?", 0).alias("x"))
    return u.join(V.facts(table(spark, d, "chunks")).select("doc_id", "fact_id", "text"), "doc_id").filter(F.contains("text", F.col("x"))).groupBy("q_id").agg(F.min("fact_id").alias("fact_id"))


@q("mx_comparison_view", with_("qu rr", "SELECT q_id, question IS NOT NULL AS asked, coalesce(r, 0) AS n_retrievals, coalesce(a, 0) AS n_answers, coalesce(p, 0) AS n_placeholder FROM qu LEFT JOIN (SELECT q_id, count(*) AS r FROM rr GROUP BY 1) USING (q_id) LEFT JOIN (SELECT q_id, count(*) AS a, count_if(trim(coalesce(predicted_answer, ''), ' ') IN ('', '-', 'n/a', 'N/A', 'null')) AS p FROM (SELECT DISTINCT ans_id, q_id, predicted_answer FROM answers) GROUP BY 1) USING (q_id)"))
def mx_comparison_view(spark: SparkSession, d: str) -> DataFrame:
    """Questions beside their retrievals and answers, with placeholder answers counted."""
    r = V.retrieval_rows(table(spark, d, "retrievals")).groupBy("q_id").agg(F.count(F.lit(1)).alias("n_retrievals"))
    a = table(spark, d, "answers").select("ans_id", "q_id", "predicted_answer").distinct()
    a = a.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_answers"), F.count_if(F.trim(F.coalesce("predicted_answer", F.lit(""))).isin("", "-", "n/a", "N/A", "null")).alias("n_placeholder"))
    u = V.questions(table(spark, d, "questions")).select("q_id", F.col("question").isNotNull().alias("asked"))
    return u.join(r, "q_id", "left").join(a, "q_id", "left").fillna(0, ["n_retrievals", "n_answers", "n_placeholder"])


@q("mx_coverage_caveat", with_("go ch", "SELECT round(avg((ch.chunk_id IS NULL)::INT), 6) AS missing, avg((ch.chunk_id IS NULL)::INT) > 0.05::DOUBLE AS warn FROM (SELECT DISTINCT chunk_id FROM go) g LEFT JOIN ch USING (chunk_id)"))
def mx_coverage_caveat(spark: SparkSession, d: str) -> DataFrame:
    """The share of wanted chunks that the store lacks, and whether to warn."""
    g = V.gold(table(spark, d, "questions")).select("chunk_id").distinct().join(_chunks(spark, d).select("chunk_id", F.lit(1).alias("f")), "chunk_id", "left")
    m = F.avg(F.col("f").isNull().cast("int"))
    return g.agg(F.round(m, 6).alias("missing"), (m > 0.05).alias("warn"))


@q("mx_budget_table", with_("fa", "SELECT doc_id, CASE WHEN p <= 24 THEN 'lo' WHEN p >= 400 THEN 'hi' ELSE 'mid' END AS clamp, greatest(24, least(400, p))::INT AS pairs FROM (SELECT doc_id, round_even(4.0::DOUBLE * round(log2(count(*) + 1.0::DOUBLE) * log2(greatest(1, count(DISTINCT page_start)) + 1.0::DOUBLE), 6), 0) AS p FROM fa GROUP BY 1)"))
def mx_budget_table(spark: SparkSession, d: str) -> DataFrame:
    """Budgets by document with the limit they ran into."""
    n, k = F.count(F.lit(1)), F.greatest(F.lit(1), F.count_distinct("page_start"))
    p = V.facts(table(spark, d, "chunks")).groupBy("doc_id").agg(F.bround(4.0 * F.round(F.log2(n + F.lit(1.0)) * F.log2(k + F.lit(1.0)), 6), 0).alias("p"))
    return p.select("doc_id", F.when(F.col("p") <= 24, "lo").when(F.col("p") >= 400, "hi").otherwise("mid").alias("clamp"), F.greatest(F.lit(24), F.least(F.lit(400), "p")).cast("int").alias("pairs"))


@q("mx_contexts", with_("rk ch", "SELECT ret_id, rank, q_id || '_ctx' || lpad(rank::VARCHAR, 3, '0') AS fact_id, substr(trim(ch.text, ' '), 1, 200) AS context FROM rk JOIN ch USING (chunk_id) WHERE rank <= 3 AND length(trim(ch.text, ' ')) >= 10"))
def mx_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The first three retrieved chunks of each list, shortened to a model's window, as pseudo facts."""
    r = V.ranked(table(spark, d, "retrievals")).filter("rank <= 3").join(_chunks(spark, d).select("chunk_id", F.trim("text").alias("t")), "chunk_id").filter(F.length("t") >= 10)
    return r.select("ret_id", "rank", F.concat("q_id", F.lit("_ctx"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("fact_id"), F.substring("t", 1, 200).alias("context"))


@q("mx_last_numbers", "SELECT ans_id, CASE WHEN len(n) > 0 THEN n[-1] END AS last_number FROM (SELECT DISTINCT ans_id, regexp_extract_all(predicted_answer, '[0-9]+(?:[.][0-9]+)?') AS n FROM answers WHERE predicted_answer IS NOT NULL)")
def mx_last_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last number that an answer gives."""
    a = table(spark, d, "answers").filter("predicted_answer is not null").select("ans_id", T.extract_all(F.col("predicted_answer"), "[0-9]+(?:[.][0-9]+)?").alias("n")).distinct()
    return a.select("ans_id", F.try_element_at("n", F.lit(-1)).alias("last_number"))


@q("mx_support_anchors", with_("fa", f"SELECT fact_id, list_sort({_CONTENT.format('text')})[1:4] AS anchors FROM fa"))
def mx_support_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Up to four distinctive words of each fact, in alphabetical order."""
    return V.facts(table(spark, d, "chunks")).select("fact_id", F.slice(F.array_sort(T.content_tokens(F.col("text"))), 1, 4).alias("anchors"))


@q("mx_cache_keys", with_("qu", "SELECT q_id, sha256('model-a' || '|' || coalesce(question, '') || '|' || array_to_string(list_sort(list_distinct(coalesce(gold_chunk_ids, []))), ',')) AS key FROM qu"))
def mx_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of cached results: the same question with the same evidence in any order has the same key."""
    ids = F.array_join(F.array_sort(F.array_distinct(F.coalesce("gold_chunk_ids", F.array().cast("array<string>")))), ",")
    return V.questions(table(spark, d, "questions")).select("q_id", F.sha2(F.concat_ws("|", F.lit("model-a"), F.coalesce("question", F.lit("")), ids), 256).alias("key"))


@q("mx_chunk_validation", "SELECT count(*) AS n, count_if(chunk_id IS NULL) AS n_without_id, count_if(coalesce(trim(text, ' '), '') = '') AS n_without_text, count_if(coalesce(char_end <= char_start, false)) AS n_bad_range FROM chunks")
def mx_chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("n_without_id"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_without_text"), F.count_if(F.coalesce(F.col("char_end") <= F.col("char_start"), F.lit(False))).alias("n_bad_range"))


@q("mx_hash_chains", with_("fa", "SELECT doc_id, list(fact_id ORDER BY h, fact_id) AS chain FROM (SELECT doc_id, fact_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h, fact_id) AS r FROM (SELECT doc_id, fact_id, md5(fact_id || ':7') AS h FROM fa)) WHERE r <= 2 GROUP BY 1"))
def mx_hash_chains(spark: SparkSession, d: str) -> DataFrame:
    """A chain of two facts per document, drawn by hash."""
    h = F.md5(F.concat("fact_id", F.lit(":7")))
    f = V.facts(table(spark, d, "chunks")).select("doc_id", "fact_id", h.alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "fact_id"))).filter("r <= 2")
    return f.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "fact_id"))), lambda x: x["fact_id"]).alias("chain"))


@q("mx_master_row", _rel_sql("SELECT count(DISTINCT q_id) AS n_questions, count(*) AS n_retrievals, round(round(avg(recall), 9), 4) AS recall_5, round(round(avg(precision), 9), 4) AS precision_5, round(round(avg(ndcg), 9), 4) AS ndcg_5, round(round(avg(mrr), 9), 4) AS mrr FROM am WHERE k = 5", True))
def mx_master_row(spark: SparkSession, d: str) -> DataFrame:
    """One row that sums up a run."""
    m = M.at_all(_rel(spark, d), (5,))
    return m.agg(F.count_distinct("q_id").alias("n_questions"), F.count(F.lit(1)).alias("n_retrievals"), F.round(F.round(F.avg("recall"), 9), 4).alias("recall_5"), F.round(F.round(F.avg("precision"), 9), 4).alias("precision_5"), F.round(F.round(F.avg("ndcg"), 9), 4).alias("ndcg_5"), F.round(F.round(F.avg("mrr"), 9), 4).alias("mrr"))


@q("nl_minimality", with_("go ch qu", f"""SELECT CASE WHEN n = 1 THEN 'single' WHEN need = n THEN 'minimal' WHEN need = 0 THEN 'redundant' ELSE 'partly' END AS verdict, count(*) AS n_questions FROM (SELECT q_id, count(*) AS n, count_if(own > 0) AS need FROM (SELECT q_id, chunk_id, len(list_filter(t, lambda x: NOT list_contains(o, x))) AS own FROM (
  SELECT a.q_id, a.chunk_id, min(a.t) AS t, coalesce(list_distinct(flatten(list(b.t) FILTER (b.t IS NOT NULL))), []) AS o FROM s a LEFT JOIN s b ON a.q_id = b.q_id AND a.chunk_id <> b.chunk_id GROUP BY 1, 2)) GROUP BY 1) GROUP BY 1""").replace("\nSELECT CASE", f",\ns AS (SELECT go.q_id, go.chunk_id, list_intersect(list_distinct({tok('qu.answer')}), list_distinct({tok('ch.text')})) AS t FROM go JOIN ch USING (chunk_id) JOIN qu ON qu.q_id = go.q_id WHERE qu.answer IS NOT NULL)\nSELECT CASE", 1))
def nl_minimality(spark: SparkSession, d: str) -> DataFrame:
    """Whether every piece of evidence supports answer tokens that no other piece does."""
    t = table(spark, d, "questions")
    u = V.questions(t).filter("answer is not null").select("q_id", F.array_distinct(T.tokens(F.col("answer"))).alias("a"))
    s = V.gold(t).join(u, "q_id").join(_chunks(spark, d).select("chunk_id", F.array_distinct(T.tokens(F.col("text"))).alias("c")), "chunk_id").select("q_id", "chunk_id", "a", F.array_intersect("a", "c").alias("t"))
    held = s.select("q_id", "chunk_id", F.explode("t").alias("x")).groupBy("q_id", "x").agg(F.count(F.lit(1)).alias("k"), F.min("chunk_id").alias("chunk_id")).filter("k = 1").select("q_id", "chunk_id").distinct().withColumn("own", F.lit(1))
    g = s.join(held, ["q_id", "chunk_id"], "left").groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count("own").alias("need"))
    v = F.when(F.col("n") == 1, "single").when(F.col("need") == F.col("n"), "minimal").when(F.col("need") == 0, "redundant").otherwise("partly")
    return g.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n_questions"))
