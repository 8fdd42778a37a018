"""Queries on joins, retrieval and evidence metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import views as V
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.plans.named import register
from quarry.plans.oracle import tok, with_
from quarry.session import table

QUERIES, SQL, q = register()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.chunk_rows(table(spark, d, "chunks"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("q_id", F.col("question").alias("text"))


def _rel(spark: SparkSession, d: str) -> DataFrame:
    return M.relevance(V.ranked(table(spark, d, "retrievals")), V.gold(table(spark, d, "questions")))


_REL = """re AS (SELECT rk.ret_id, rk.q_id, rk.mode, count(*) AS n, list(rank ORDER BY rank) FILTER (g.chunk_id IS NOT NULL) AS rel0, min(n_gold) AS n_gold FROM rk JOIN (SELECT q_id, count(*) AS n_gold FROM go GROUP BY 1) x USING (q_id) LEFT JOIN go g ON g.q_id = rk.q_id AND g.chunk_id = rk.chunk_id GROUP BY 1, 2, 3),
rl AS (SELECT *, coalesce(rel0, []) AS rel FROM re)"""
_AT = """, ak AS (SELECT ret_id, q_id, mode, k, list_filter(rel, lambda x: x <= k) AS r, n_gold, rel, n FROM rl, (VALUES (1), (3), (5), (10)) v(k)),
am AS (SELECT ret_id, q_id, mode, k, len(r)::DOUBLE / n_gold AS recall, len(r)::DOUBLE / k AS precision, CASE WHEN len(r) > 0 THEN list_sum(list_transform(range(1, len(r) + 1), lambda i: i::DOUBLE / r[i])) / len(r) ELSE 0.0 END AS precision_rw, (len(r) = n_gold)::INT AS hit,
  CASE WHEN len(r) > 0 THEN list_sum(list_transform(r, lambda x: 1.0::DOUBLE / log2(x + 1.0::DOUBLE))) / list_sum(list_transform(range(1, len(r) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0.0 END AS ndcg, CASE WHEN len(rel) > 0 THEN 1.0::DOUBLE / rel[1] ELSE 0.0 END AS mrr FROM ak)"""


def _rel_sql(body: str, at: bool = False) -> str:
    s = with_("rk go", "")
    return s.rstrip() + ",\n" + _REL + (_AT if at else "") + "\n" + body


def _bm25(queries: str, units: str, keys: str = "", query: str = "q_id", unit: str = "chunk_id") -> str:
    k = f"{keys}, " if keys else ""
    on = " AND ".join([f"a.{c} = p.{c}" for c in [*([keys] if keys else []), "token"]])
    return f"""po AS (SELECT {k}{unit}, token, count(*) AS tf FROM (SELECT {k}{unit}, unnest({tok('text')}) AS token FROM {units}) GROUP BY ALL), dl AS (SELECT {k}{unit}, len({tok('text')}) AS dl FROM {units}),
st AS (SELECT {k}count(*) AS n, sum(dl)::DOUBLE / greatest(count(*), 1) AS avgdl FROM dl {'GROUP BY ' + keys if keys else ''}), df AS (SELECT {k}token, count(*) AS df FROM po GROUP BY ALL),
aq AS (SELECT {query}, {k}unnest(list_distinct({tok('text')})) AS token FROM {queries}),
bm AS (SELECT {', '.join('a.' + c.strip() for c in query.split(','))}, p.{unit}, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM aq a JOIN po p ON {on} JOIN df f ON {on.replace('p.', 'f.')} JOIN dl l ON l.{unit} = p.{unit} {f'AND l.{keys} = p.{keys}' if keys else ''} JOIN st ON {f'st.{keys} = p.{keys}' if keys else 'true'} GROUP BY ALL)"""


_EV = "ev AS (SELECT q_id, question AS text FROM eval_items)"
_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY score DESC, {1}) AS rank FROM {2}) WHERE rank <= {3}"


@q("rt_index_stats", f"WITH x AS ({with_('ch', '').strip()[5:].split(' AS (', 1)[1].rsplit(')', 1)[0]}) SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (SELECT chunk_id, unnest({tok('text')}) AS token FROM x) GROUP BY 1")
def rt_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_chunks(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@q("rt_bm25_topk", with_("ch", "").rstrip() + f",\n{_EV},\n{_bm25('ev', 'ch')}\n" + _TOP.format("q_id", "chunk_id", "bm", 10))
def rt_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_top(_asked(spark, d), _chunks(spark, d), 10)


_OWN = "ow AS (SELECT q_id, doc_id, question AS text FROM qu WHERE question IS NOT NULL)"


@q("rt_bm25_within_document", with_("ch qu", "").rstrip() + f",\n{_OWN},\n{_bm25('ow', 'ch', 'doc_id')}\n" + _TOP.format("q_id", "chunk_id", "bm", 3))
def rt_bm25_within_document(spark: SparkSession, d: str) -> DataFrame:
    """Questions against the chunks of their own document, with that document's frequencies."""
    own = V.questions(table(spark, d, "questions")).filter("question is not null").select("q_id", "doc_id", F.col("question").alias("text"))
    return R.top_k(R.bm25(own, _chunks(spark, d), ("doc_id",)), 3)


@q("rt_dense_topk", """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id,
  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def rt_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.nearest(e, e.filter("vec_id % 20 = 0"), 5)


@q("rt_fuse_modes", with_("rk", "SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT q_id, mode, chunk_id, min(rank) AS rank FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE rank <= 10"))
def rt_fuse_modes(spark: SparkSession, d: str) -> DataFrame:
    """The logged lists of a question's search modes, fused; a chunk counts once per mode, at its best rank."""
    best = V.ranked(table(spark, d, "retrievals")).groupBy("q_id", "mode", "chunk_id").agg(F.min("rank").alias("rank"))
    return R.top_k(R.fuse(best), 10)


_SUB = r"su AS (SELECT q_id, text AS sub, text FROM ev UNION SELECT q_id, s AS sub, s AS text FROM (SELECT q_id, unnest(string_split_regex(text, '[,:;]\s+|\s+(?:and|und|et|y)\s+')) AS s FROM ev) WHERE length(s) >= 15)"


@q("rt_decomposed", with_("ch", "").rstrip() + f",\n{_EV},\n{_SUB},\n{_bm25('su', 'ch', '', 'q_id, sub')},\nli AS (" + _TOP.format("q_id, sub", "chunk_id", "bm", 10) + ")\nSELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM li GROUP BY 1, 2)) WHERE rank <= 5")
def rt_decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Questions and their parts searched each for itself, the lists fused."""
    a = _asked(spark, d)
    parts = a.select("q_id", F.explode(F.split("text", r"[,:;]\s+|\s+(?:and|und|et|y)\s+")).alias("sub")).filter(F.length("sub") >= 15)
    subs = a.select("q_id", F.col("text").alias("sub")).unionByName(parts).distinct().withColumn("text", F.col("sub"))
    return R.top_k(R.fuse(R.bm25_top(subs, _chunks(spark, d), 10, ("q_id", "sub"))), 5)


_CAND = f"""ca AS (SELECT rk.ret_id, rk.rank, rk.chunk_id, ch.page_start, len(list_intersect(list_distinct(qt), list_distinct({tok('ch.text')})))::DOUBLE / greatest(1, len(list_distinct(qt))) AS overlap FROM rk JOIN (SELECT q_id, {tok('question')} AS qt FROM qu WHERE question IS NOT NULL) USING (q_id) JOIN ch USING (chunk_id))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks with the share of their question's tokens that they hold."""
    u = V.questions(table(spark, d, "questions")).filter("question is not null").select("q_id", "question", F.array_distinct(T.tokens(F.col("question"))).alias("qt"))
    held = _chunks(spark, d).select("chunk_id", "text", "page_start", F.array_distinct(T.tokens(F.col("text"))).alias("ct"))
    c = V.ranked(table(spark, d, "retrievals")).join(u, "q_id").join(held, "chunk_id")
    return c.withColumn("overlap", F.size(F.array_intersect("qt", "ct")) / F.greatest(F.lit(1), F.size("qt")))


@q("rt_rerank_overlap", with_("rk qu ch", "").rstrip() + f",\n{_CAND}\nSELECT ret_id, chunk_id, score, rank FROM (SELECT ret_id, chunk_id, round(overlap, 6) AS score, row_number() OVER (PARTITION BY ret_id ORDER BY round(overlap, 6) DESC, chunk_id) AS rank FROM ca) WHERE rank <= 3")
def rt_rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates reranked by a score of question and chunk; token overlap stands in for a model's."""
    c = _candidates(spark, d).select("ret_id", "chunk_id", F.round("overlap", 6).alias("score"))
    return R.top_k(c, 3, ("ret_id",))


@q("rt_complementary")
def rt_complementary(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank_complementary(_candidates(spark, d).select("ret_id", "question", "chunk_id", "text", F.col("page_start").alias("page"), F.col("overlap").alias("score")), 3)


@q("rt_compress", with_("rk qu ch", "").rstrip() + f""",\n{_CAND}\nSELECT ret_id, chunk_id, round(CASE WHEN hi > lo THEN (overlap - lo) / (hi - lo) ELSE 1.0 END + 0.3::DOUBLE * CASE WHEN rhi > rlo THEN (rr - rlo) / (rhi - rlo) ELSE 1.0 END, 6) AS blended
  FROM (SELECT *, min(overlap) OVER w AS lo, max(overlap) OVER w AS hi, min(rr) OVER w AS rlo, max(rr) OVER w AS rhi FROM (SELECT *, 1.0::DOUBLE / (rank + 1) AS rr FROM ca) WINDOW w AS (PARTITION BY ret_id))""")
def rt_compress(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ret_id")
    c = _candidates(spark, d)
    return c.select("ret_id", "chunk_id", F.round(R.minmax(F.col("overlap"), w) + 0.3 * R.minmax(1 / (F.col("rank") + 1), w), 6).alias("blended"))


@q("rt_adaptive_k", _rel_sql("SELECT ret_id, coalesce(min(k) FILTER (len(r) >= n_gold * 0.5::DOUBLE), 10)::INT AS k, count(*) FILTER (len(r) >= n_gold * 0.5::DOUBLE) > 0 AS met FROM ak GROUP BY 1", True))
def rt_adaptive_k(spark: SparkSession, d: str) -> DataFrame:
    """The least k that reaches half of the evidence, else the greatest."""
    ks = F.filter(F.array(*(F.lit(k) for k in M.KS)), lambda k: F.size(F.filter("rel", lambda r: r <= k)) >= F.col("n_gold") * 0.5)
    return _rel(spark, d).select("ret_id", F.coalesce(F.array_min(ks), F.lit(10)).alias("k"), (F.size(ks) > 0).alias("met"))


_FB = "fb AS (SELECT fact_id, text FROM fa)"


@q("rt_fact_indexed", with_("fa", "").rstrip() + f",\n{_EV},\n{_FB},\n{_bm25('ev', 'fb', '', 'q_id', 'fact_id')},\ntf AS (" + _TOP.format("q_id", "fact_id", "bm", 30) + ")\nSELECT q_id, chunk_id, rank FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY best, chunk_id) AS rank FROM (SELECT q_id, chunk_id, min(rank) AS best FROM tf JOIN fa USING (fact_id) GROUP BY 1, 2)) WHERE rank <= 5")
def rt_fact_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Facts are ranked, then each chunk by its best fact."""
    f = V.facts(table(spark, d, "chunks"))
    best = R.bm25_top(_asked(spark, d), f.select("fact_id", "text"), 30, unit="fact_id").join(f.select("fact_id", "chunk_id"), "fact_id").groupBy("q_id", "chunk_id").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("best", "chunk_id"))).filter("rank <= 5").select("q_id", "chunk_id", "rank")


@q("rt_anchored_text", with_("ch fa", "SELECT chunk_id, md5(text || coalesce(' FACTS: ' || f, '')) AS h FROM ch LEFT JOIN (SELECT chunk_id, string_agg(text, ' | ' ORDER BY order_idx) AS f FROM fa GROUP BY 1) USING (chunk_id)"))
def rt_anchored_text(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their facts appended, as another text to index."""
    f = V.facts(table(spark, d, "chunks")).groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda x: x["text"]), " | ").alias("f"))
    return _chunks(spark, d).join(f, "chunk_id", "left").select("chunk_id", F.md5(F.concat("text", F.coalesce(F.concat(F.lit(" FACTS: "), "f"), F.lit("")))).alias("h"))


def retriever(strategy: str):
    """(queries, units, k) -> ranked units, by strategy: bm25, dense or hybrid (both, fused).

    bm25 takes texts, dense vectors (vec_id, embedding), hybrid a pair of each. Other names raise ValueError.
    """
    def dense(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
        return R.nearest(units, queries, k)

    def hybrid(queries: tuple[DataFrame, DataFrame], units: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
        words = R.bm25_top(queries[0], units[0], 2 * k).select("q_id", "chunk_id", "rank")
        near = R.nearest(units[1], queries[1], 2 * k).select(F.col("query_id").cast("string").alias("q_id"), F.col("vec_id").cast("string").alias("chunk_id"), "rank")
        return R.top_k(R.fuse(words.select(F.col("q_id").cast("string").alias("q_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "rank").unionByName(near)), k)

    known = {"bm25": R.bm25_top, "dense": dense, "hybrid": hybrid}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}, known are {', '.join(known)}")
    return known[strategy]


@q("jo_logs_matched", "SELECT count(*) AS n_questions, count_if(r) AS n_retrieved, count_if(a) AS n_answered, count_if(r AND a) AS n_both FROM (SELECT q_id, q_id IN (SELECT q_id FROM retrievals) AS r, q_id IN (SELECT q_id FROM answers) AS a FROM (SELECT DISTINCT q_id FROM questions))".replace("(SELECT q_id FROM retrievals)", "(SELECT q_id FROM retrievals WHERE q_id IS NOT NULL)"))
def jo_logs_matched(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: table(spark, d, t).select("q_id").filter("q_id is not null").distinct()
    m = ids("questions").join(ids("retrievals").withColumn("r", F.lit(True)), "q_id", "left").join(ids("answers").withColumn("a", F.lit(True)), "q_id", "left")
    return m.agg(F.count(F.lit(1)).alias("n_questions"), F.count("r").alias("n_retrieved"), F.count("a").alias("n_answered"), F.count_if(F.col("r") & F.col("a")).alias("n_both"))


_SPANS = "sp AS (SELECT DISTINCT doc_id, c.chunk_id AS span_id, c.char_start AS s, c.char_end AS e FROM (SELECT doc_id, unnest(chunks) AS c FROM chunk_results)), ov AS (SELECT sp.span_id, sp.s, sp.e, ch.chunk_id, ch.char_start, (least(e, char_end) - greatest(s, char_start))::DOUBLE / greatest(1, e - s) AS share FROM sp JOIN ch ON ch.doc_id = sp.doc_id AND least(e, char_end) - greatest(s, char_start) > 0)"


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Spans of chunk results against chunk ranges of the same document."""
    sp = table(spark, d, "chunk_results").select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.chunk_id").alias("span_id"), F.col("c.char_start").alias("s"), F.col("c.char_end").alias("e")).distinct()
    n = F.least("e", "char_end") - F.greatest("s", "char_start")
    both = F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    return sp.join(_chunks(spark, d).drop("text"), "doc_id").filter(both & (n > 0)).withColumn("share", n / F.greatest(F.lit(1), F.col("e") - F.col("s")))


@q("jo_span_overlaps", with_("ch", "").rstrip() + f",\n{_SPANS}\nSELECT span_id, s, e, chunk_id, round(share, 6) AS share FROM ov WHERE s IS NOT NULL AND e IS NOT NULL AND char_start IS NOT NULL AND share >= 0.1")
def jo_span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).filter("share >= 0.1").select("span_id", "s", "e", "chunk_id", F.round("share", 6).alias("share"))


@q("jo_span_best_chunk", with_("ch", "").rstrip() + f",\n{_SPANS}\nSELECT span_id, s, e, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY span_id, s, e ORDER BY share DESC, char_start, chunk_id) AS r FROM ov JOIN (SELECT chunk_id, char_end FROM ch WHERE char_end IS NOT NULL) USING (chunk_id) WHERE s IS NOT NULL AND e IS NOT NULL AND char_start IS NOT NULL) WHERE r = 1")
def jo_span_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("span_id", "s", "e").orderBy(F.desc("share"), "char_start", "chunk_id")
    return _overlaps(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("span_id", "s", "e", "chunk_id")


@q("jo_line_in_chunk", with_("ch li", "SELECT li.doc_id, li.line_idx, min_by(chunk_id, (char_start2, chunk_id)) AS chunk_id FROM li JOIN (SELECT chunk_id, doc_id, char_start AS char_start2, char_end FROM ch WHERE char_start IS NOT NULL AND char_end IS NOT NULL) c ON c.doc_id = li.doc_id AND c.char_start2 <= li.char_start AND li.char_start < c.char_end GROUP BY 1, 2"))
def jo_line_in_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk whose half-open range holds a line's start."""
    c = _chunks(spark, d).filter("char_start is not null and char_end is not null").select("chunk_id", "doc_id", F.col("char_start").alias("a"), "char_end")
    hit = V.lines(table(spark, d, "documents")).join(c, "doc_id").filter("a <= char_start and char_start < char_end")
    return hit.groupBy("doc_id", "line_idx").agg(F.min_by("chunk_id", F.struct("a", "chunk_id")).alias("chunk_id"))


_UNIT = f"un AS (SELECT q_id, {tok('answer')} AS ut FROM qu WHERE answer IS NOT NULL), hi AS (SELECT go.q_id, go.chunk_id, ut, list_distinct({tok('ch.text')}) AS ct FROM go JOIN un USING (q_id) JOIN ch USING (chunk_id) WHERE len(ut) > 0)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "questions")
    u = V.questions(t).filter("answer is not null").select("q_id", T.tokens(F.col("answer")).alias("ut"))
    return V.gold(t).join(u, "q_id").join(_chunks(spark, d), "chunk_id").filter(F.size("ut") > 0).withColumn("ct", F.array_distinct(T.tokens(F.col("text"))))


@q("jo_containment_repeats", with_("go ch qu", "").rstrip() + f",\n{_UNIT}\nSELECT q_id, chunk_id, round(len(list_filter(ut, lambda x: list_contains(ct, x)))::DOUBLE / len(ut), 6) AS held, len(list_filter(ut, lambda x: list_contains(ct, x))) >= len(ut) * 0.6::DOUBLE AS hit FROM hi")
def jo_containment_repeats(spark: SparkSession, d: str) -> DataFrame:
    s = T.share_held(F.col("ut"), F.col("ct"))
    return _held(spark, d).select("q_id", "chunk_id", F.round(s, 6).alias("held"), (T.count_held(F.col("ut"), F.col("ct")) >= F.size("ut") * 0.6).alias("hit"))


@q("jo_containment_distinct", with_("go ch qu", "").rstrip() + f",\n{_UNIT}\nSELECT q_id, chunk_id, round(len(list_intersect(list_distinct(ut), ct))::DOUBLE / len(list_distinct(ut)), 6) AS held FROM hi")
def jo_containment_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select("q_id", "chunk_id", F.round(T.share_held_set(F.col("ut"), F.col("ct")), 6).alias("held"))


@q("jo_grounded_pairs", with_("go ch qu", "").rstrip() + f",\n{_UNIT}\nSELECT q_id, max_by(chunk_id, (held, chunk_id)) AS chunk_id, round(max(held), 6) AS held, max(held) >= 0.6::DOUBLE AS grounded FROM (SELECT *, len(list_intersect(list_distinct(ut), ct))::DOUBLE / len(list_distinct(ut)) AS held FROM hi) GROUP BY 1")
def jo_grounded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The evidence chunk that holds most of each gold answer, and whether it holds enough."""
    h = _held(spark, d).withColumn("held", T.share_held_set(F.col("ut"), F.col("ct")))
    return h.groupBy("q_id").agg(F.max_by("chunk_id", F.struct("held", "chunk_id")).alias("chunk_id"), F.round(F.max("held"), 6).alias("held"), (F.max("held") >= 0.6).alias("grounded"))


@q("jo_source_neighbours", with_("fa", "SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, b.order_idx - a.order_idx AS distance FROM fa a JOIN fa b ON a.doc_id = b.doc_id AND b.order_idx > a.order_idx AND b.order_idx <= a.order_idx + 2 AND abs(b.page_start - a.page_start) <= 1"))
def jo_source_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Facts up to two places apart in reading order and a page apart at most; found by lead, without a self-join."""
    w = Window.partitionBy("doc_id").orderBy("order_idx")
    f = V.facts(table(spark, d, "chunks"))
    near = F.array(*(F.struct(F.lead("fact_id", k).over(w).alias("fact_b"), F.lead("page_start", k).over(w).alias("p"), F.lit(k).alias("distance")) for k in (1, 2)))
    f = f.withColumn("near", near)
    return f.select(F.col("fact_id").alias("fact_a"), "page_start", F.explode("near").alias("x")).filter("x.fact_b is not null and abs(x.p - page_start) <= 1").select("fact_a", "x.fact_b", "x.distance")


@q("jo_band_neighbours", """SELECT a.vec_id, min_by(b.vec_id, (abs(b.vec_id - a.vec_id), b.vec_id)) AS neighbour FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id <> a.vec_id AND abs(b.vec_id - a.vec_id) <= 30 GROUP BY 1""")
def jo_band_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest row of the same label within 30 ids, the earlier on ties: an equi-join on label and bucket of 30 ids."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 30").alias("b"))
    o = e.select(F.col("vec_id").alias("o"), "label", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    hit = e.join(o, ["label", "b"]).filter("o <> vec_id and abs(o - vec_id) <= 30")
    return hit.groupBy("vec_id").agg(F.min_by("o", F.struct(F.abs(F.col("o") - F.col("vec_id")), "o")).alias("neighbour"))


@q("jo_coverage", with_("go ch", "SELECT count(DISTINCT chunk_id) AS requested, count(DISTINCT chunk_id) FILTER (f) AS found, count(DISTINCT chunk_id) FILTER (NOT f) AS missing, CASE WHEN count(DISTINCT chunk_id) = 0 THEN 1.0 ELSE round(count(DISTINCT chunk_id) FILTER (f)::DOUBLE / count(DISTINCT chunk_id), 6) END AS coverage FROM (SELECT go.chunk_id, ch.chunk_id IS NOT NULL AS f FROM go LEFT JOIN ch USING (chunk_id))"))
def jo_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of the chunks that questions ask for exist; nothing asked for counts as covered."""
    asked = V.gold(table(spark, d, "questions")).select("chunk_id").distinct()
    f = asked.join(_chunks(spark, d).select("chunk_id", F.lit(1).alias("f")), "chunk_id", "left")
    n, k = F.count(F.lit(1)), F.count("f")
    return f.agg(n.alias("requested"), k.alias("found"), (n - k).alias("missing"), F.when(n == 0, 1.0).otherwise(F.round(k / n, 6)).alias("coverage"))


@q("jo_missing_chunks", with_("go ch", "SELECT DISTINCT chunk_id FROM go WHERE chunk_id NOT IN (SELECT chunk_id FROM ch)"))
def jo_missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.gold(table(spark, d, "questions")).select("chunk_id").distinct().join(_chunks(spark, d), "chunk_id", "left_anti")


@q("ev_relevance", _rel_sql("SELECT ret_id, q_id, mode, n, n_gold, rel FROM rl"))
def ev_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _rel(spark, d).select("ret_id", "q_id", "mode", "n", "n_gold", "rel")


_METRICS = ("recall", "precision", "precision_rw", "ndcg", "mrr")


@q("ev_metrics_at_k", _rel_sql(f"SELECT ret_id, q_id, mode, k, hit, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM am", True))
def ev_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.at_all(_rel(spark, d)).select("ret_id", "q_id", "mode", "k", "hit", *(F.round(m, 6).alias(m) for m in _METRICS))


@q("ev_list_metrics", _rel_sql("""SELECT ret_id, round(len(rel)::DOUBLE / n_gold, 6) AS fact_recall, round(len(rel)::DOUBLE / n, 6) AS fact_precision, round(CASE WHEN len(rel) > 0 THEN 2 * (len(rel)::DOUBLE / n_gold) * (len(rel)::DOUBLE / n) / (len(rel)::DOUBLE / n_gold + len(rel)::DOUBLE / n) ELSE 0 END, 6) AS fact_f1, round(1 - len(rel)::DOUBLE / n, 6) AS over_retrieval,
  len(rel) = n_gold AS joint, len(rel) > 0 AS any_hit, round(CASE WHEN len(rel) > 0 THEN list_sum(list_transform(rel, lambda x: 1.0::DOUBLE / x)) / len(rel) ELSE 0 END, 6) AS mrr_all FROM rl"""))
def ev_list_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Over whole lists: recall, precision over what was retrieved, F1 per list, joint and any hit, mean of all reciprocal ranks."""
    r = _rel(spark, d)
    rec, pre = F.size("rel") / F.col("n_gold"), M.precision_of_list(F.col("rel"), F.col("n"))
    return r.select("ret_id", F.round(rec, 6).alias("fact_recall"), F.round(pre, 6).alias("fact_precision"), F.round(M.f1(pre, rec), 6).alias("fact_f1"), F.round(1 - pre, 6).alias("over_retrieval"), (F.size("rel") == F.col("n_gold")).alias("joint"), (F.size("rel") > 0).alias("any_hit"), F.round(M.mean_reciprocal(F.col("rel")), 6).alias("mrr_all"))


_TF = "(SELECT chunk_id, list_distinct(t) AS u, map_from_entries(list_transform(list_distinct(t), lambda w: (w, len(list_filter(t, lambda x: x = w))))) AS m FROM (SELECT chunk_id, " + tok("text") + " AS t FROM ch))"
_LAYERS = f"""rq AS (SELECT DISTINCT ret_id, q_id FROM rk), wa AS (SELECT ret_id, q_id, go.chunk_id FROM rq JOIN go USING (q_id)), me AS (SELECT DISTINCT wa.ret_id, wa.chunk_id, rk.chunk_id AS other FROM wa JOIN rk USING (ret_id)), tf AS MATERIALIZED {_TF},
sc AS (SELECT chunk_id, other, round(CASE WHEN len(u) > 0 THEN len(list_intersect(u, ou))::DOUBLE / len(u) ELSE 0 END, 6) AS held, round(CASE WHEN len(u) > 0 AND len(ou) > 0 THEN list_sum(list_transform(u, lambda w: m[w] * coalesce(om[w], 0)))::DOUBLE / (sqrt(list_sum(list_transform(map_values(m), lambda x: x * x))) * sqrt(list_sum(list_transform(map_values(om), lambda x: x * x)))) ELSE 0 END, 6) AS cosine
  FROM (SELECT p.chunk_id, p.other, a.u, a.m, b.u AS ou, b.m AS om FROM (SELECT DISTINCT chunk_id, other FROM me) p JOIN tf a ON a.chunk_id = p.chunk_id JOIN tf b ON b.chunk_id = p.other)),
bs AS (SELECT ret_id, chunk_id, max(held) AS held, max(cosine) AS cosine FROM me JOIN sc USING (chunk_id, other) GROUP BY 1, 2),
ly AS (SELECT wa.ret_id, wa.q_id, EXISTS (SELECT 1 FROM rk WHERE rk.ret_id = wa.ret_id AND rk.chunk_id = wa.chunk_id) AS a, coalesce(held >= {M.IN_WORDS}::DOUBLE, false) AS b, coalesce(cosine >= {M.BY_VECTOR}::DOUBLE, false) AS c FROM wa LEFT JOIN bs ON bs.ret_id = wa.ret_id AND bs.chunk_id = wa.chunk_id)"""


@q("ev_layers", with_("rk go ch", "").rstrip() + f",\n{_LAYERS}\nSELECT ret_id, q_id, count(*) AS n, round(avg(a::INT), 6) AS recall, round(avg(b::INT), 6) AS text_recall, round(avg((a AND b)::INT), 6) AS strict_recall, round(avg(c::INT), 6) AS text_recall_l3, round(avg((a AND c)::INT), 6) AS strict_recall_l13, round(avg((a OR b OR c)::INT), 6) AS text_recall_any FROM ly GROUP BY 1, 2")
def ev_layers(spark: SparkSession, d: str) -> DataFrame:
    """Evidence found by its id, in words, by vector, and by combinations of them."""
    t = table(spark, d, "questions")
    return M.layered(M.layers(V.ranked(table(spark, d, "retrievals")), V.gold(t), _chunks(spark, d).select("chunk_id", "text")))


@q("ev_group_recall", with_("rk go ch", "").rstrip() + """,\nrg AS (SELECT q_id, chunk_id, coalesce(page_start, -1) AS grp FROM go JOIN ch USING (chunk_id)), rq AS (SELECT DISTINCT ret_id, q_id FROM rk), gr AS (SELECT ret_id, grp, min(EXISTS (SELECT 1 FROM rk WHERE rk.ret_id = rq.ret_id AND rk.chunk_id = rg.chunk_id)::INT) AS met FROM rq JOIN rg USING (q_id) GROUP BY 1, 2)
SELECT ret_id, count(*) AS n_groups, round(avg(met), 6) AS group_recall, min(met) = 1 AS joint FROM gr GROUP BY 1""")
def ev_group_recall(spark: SparkSession, d: str) -> DataFrame:
    """Evidence in groups, the chunks of one page: the share of groups found whole, and whether all are."""
    required = V.gold(table(spark, d, "questions")).join(_chunks(spark, d).select("chunk_id", F.coalesce("page_start", F.lit(-1)).alias("grp")), "chunk_id")
    return M.group_recall(V.ranked(table(spark, d, "retrievals")), required)


_SWEEP = """sw AS (SELECT mode, k, count(*) AS n, round(avg(recall), 9) AS r, round(avg(precision), 9) AS p, round(avg(precision_rw), 9) AS w, round(avg(hit), 9) AS h FROM am GROUP BY 1, 2),
sr AS (SELECT mode, k, n, round(r, 4) AS recall, round(p, 4) AS precision, round(w, 4) AS precision_rw, round(CASE WHEN r + p > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(CASE WHEN r + w > 0 THEN 2 * w * r / (w + r) ELSE 0 END, 4) AS f1_rw, round(h, 4) AS hit_rate FROM sw)"""


@q("ev_sweep", _rel_sql("", True).rstrip() + f",\n{_SWEEP}\nSELECT * FROM sr")
def ev_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.sweep(M.at_all(_rel(spark, d)))


@q("ev_leaderboard", _rel_sql("", True).rstrip() + f",\n{_SWEEP}\nSELECT * FROM sr ORDER BY f1_rw DESC, k, mode LIMIT 5")
def ev_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return M.sweep(M.at_all(_rel(spark, d))).orderBy(F.desc("f1_rw"), "k", "mode").limit(5)


@q("ev_winner", _rel_sql("", True).rstrip() + f",\n{_SWEEP}\nSELECT mode, k, f1_rw FROM sr ORDER BY f1_rw DESC, k, mode LIMIT 1")
def ev_winner(spark: SparkSession, d: str) -> DataFrame:
    return M.sweep(M.at_all(_rel(spark, d))).orderBy(F.desc("f1_rw"), "k", "mode").limit(1).select("mode", "k", "f1_rw")


@q("ev_by_hop_type", _rel_sql("SELECT coalesce(hop_type, 'all') AS hop_type, count(*) AS n, round(avg(len(rel)::DOUBLE / n_gold), 6) AS recall, round(avg(len(rel)::DOUBLE / n), 6) AS precision, round(avg((len(rel) = n_gold)::INT), 6) AS hit_rate FROM rl JOIN (SELECT q_id, hop_type FROM qu) USING (q_id) GROUP BY GROUPING SETS ((), (hop_type))"))
def ev_by_hop_type(spark: SparkSession, d: str) -> DataFrame:
    """Means over all and by hop type, in one pass."""
    r = _rel(spark, d).join(V.questions(table(spark, d, "questions")).select("q_id", "hop_type"), "q_id")
    return r.rollup("hop_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("rel") / F.col("n_gold")), 6).alias("recall"), F.round(F.avg(F.size("rel") / F.col("n")), 6).alias("precision"), F.round(F.avg((F.size("rel") == F.col("n_gold")).cast("int")), 6).alias("hit_rate")).withColumn("hop_type", F.coalesce("hop_type", F.lit("all")))


@q("ev_clause_scores", with_("rk qu ch", f"""SELECT ret_id, q_id, count(*) AS n_units, round(avg(CASE WHEN held >= 0.6::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS recall, bool_and(held >= 0.6::DOUBLE) AS hit FROM (
  SELECT ret_id, q_id, unit_id, max(len(list_filter(ut, lambda x: list_contains(ct, x)))::DOUBLE / len(ut)) AS held FROM (SELECT rk.ret_id, rk.q_id, list_distinct({tok('ch.text')}) AS ct FROM rk JOIN ch USING (chunk_id)) l
  JOIN (SELECT q_id, unit_id, {tok('unit')} AS ut FROM (SELECT q_id, unnest(l) AS unit, unnest(range(len(l))) AS unit_id FROM (SELECT q_id, regexp_extract_all(answer, '[^.!?]+(?:[.!?]+|$)') AS l FROM qu))) u USING (q_id) WHERE len(ut) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def ev_clause_scores(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of the gold answer found in one retrieved chunk each, by token containment."""
    units = V.questions(table(spark, d, "questions")).select("q_id", F.posexplode(T.extract_all(F.col("answer"), "[^.!?]+(?:[.!?]+|$)")).alias("unit_id", "unit")).filter(F.size(T.tokens(F.col("unit"))) > 0)
    lists = V.ranked(table(spark, d, "retrievals")).join(_chunks(spark, d).select("chunk_id", F.array_distinct(T.tokens(F.col("text"))).alias("ct")), "chunk_id")
    h = M.unit_hits(units, lists)
    return h.groupBy("ret_id", "q_id").agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.bool_and("hit").alias("hit"))


@q("ev_answer_overlap", with_("qu", f"""SELECT model, count(*) AS n, round(avg(s), 6) AS token_f1, round(avg((abstained)::INT), 6) AS abstained FROM (SELECT coalesce(lower(trim(model_name)), 'unknown') AS model, coalesce(abstained, false) AS abstained, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END AS s
  FROM (SELECT DISTINCT ans_id, model_name, abstained, list_distinct({tok("coalesce(predicted_answer, '')")}) AS p, list_distinct({tok("coalesce(answer, '')")}) AS g FROM answers JOIN qu USING (q_id))) GROUP BY 1"""))
def ev_answer_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of logged with gold answers by model, and how often a model abstains."""
    toks = lambda c: F.array_distinct(T.tokens(F.coalesce(c, F.lit(""))))
    a = table(spark, d, "answers").dropDuplicates(["ans_id", "model_name", "abstained", "predicted_answer"]).join(V.questions(table(spark, d, "questions")).select("q_id", "answer"), "q_id")
    a = a.select(F.coalesce(F.lower(F.trim("model_name")), F.lit("unknown")).alias("model"), F.coalesce("abstained", F.lit(False)).alias("abstained"), toks(F.col("predicted_answer")).alias("p"), toks(F.col("answer")).alias("g"))
    s = F.when((F.size("p") == 0) | (F.size("g") == 0), 0.0).otherwise(2 * F.size(F.array_intersect("p", "g")) / (F.size("p") + F.size("g")))
    return a.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("token_f1"), F.round(F.avg(F.col("abstained").cast("int")), 6).alias("abstained"))


_G4 = "list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i + 3], ' '))"


@q("ev_ngram_overlap", with_("go qu ch", f"SELECT q_id, chunk_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_filter(a, lambda x: list_contains(c, x)))::DOUBLE / len(a), 6) END AS share FROM (SELECT go.q_id, go.chunk_id, {_G4.format('x')} AS a, {_G4.format('y')} AS c FROM go JOIN (SELECT q_id, {tok('answer')} AS x FROM qu WHERE answer IS NOT NULL) USING (q_id) JOIN (SELECT chunk_id, {tok('text')} AS y FROM ch) USING (chunk_id))"))
def ev_ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of the gold answer's runs of four tokens that an evidence chunk has."""
    t = table(spark, d, "questions")
    rows = V.gold(t).join(V.questions(t).filter("answer is not null").select("q_id", T.ngrams(T.tokens(F.col("answer")), 4).alias("a")), "q_id").join(_chunks(spark, d).select("chunk_id", T.ngrams(T.tokens(F.col("text")), 4).alias("c")), "chunk_id")
    return rows.select("q_id", "chunk_id", F.when(F.size("a") == 0, 0.0).otherwise(F.round(F.size(F.filter("a", lambda x: F.array_contains("c", x))) / F.greatest(F.size("a"), F.lit(1)), 6)).alias("share"))
