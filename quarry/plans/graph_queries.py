"""Queries on the fact graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.functions import views as V
from quarry.operators import chains as C
from quarry.operators import graph as G
from quarry.plans.filter_queries import _CONTENT, _STRICT, _case, _plain
from quarry.plans.named import register
from quarry.plans.oracle import with_
from quarry.session import table

QUERIES, SQL, q = register()


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(table(spark, d, "chunks"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_FOLD = "CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
_PHRASES = f"""bt AS (SELECT doc_id, fact_id, page_start AS page, list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {_FOLD}) AS t FROM fa),
ph AS (SELECT DISTINCT doc_id, fact_id, page, array_to_string(g, ' ') AS norm FROM (SELECT doc_id, fact_id, page, t[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT * FROM bt, (VALUES (2), (3), (4)) v(n)) WHERE len(t) >= n))
  WHERE NOT list_contains({_STOP}, g[1]) AND NOT list_contains({_STOP}, g[-1]) AND len(list_filter(g, lambda x: regexp_matches(x, '^[a-z]{{4,}}$'))) > 0),
bg AS (SELECT doc_id, fact_ids, max_by(norm, (length(norm), norm)) AS norm FROM (SELECT doc_id, norm, list_sort(list(DISTINCT fact_id)) AS fact_ids FROM ph GROUP BY 1, 2 HAVING count(DISTINCT fact_id) >= 2 AND count(DISTINCT page) BETWEEN 2 AND 4) GROUP BY 1, 2)"""
_FA = with_("fa", "").rstrip()


@q("gr_bridge_phrases", f"{_FA},\n{_PHRASES}\nSELECT norm, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs FROM ph GROUP BY 1 HAVING count(*) >= 3")
def gr_bridge_phrases(spark: SparkSession, d: str) -> DataFrame:
    return G.phrases(_facts(spark, d)).groupBy("norm", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("norm").agg(F.sum("c").alias("n_facts"), F.count(F.lit(1)).alias("n_docs")).filter("n_facts >= 3")


@q("gr_bridge_groups", f"{_FA},\n{_PHRASES}\nSELECT doc_id, norm, fact_ids FROM bg")
def gr_bridge_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.bridge_groups(_facts(spark, d)).select("doc_id", "norm", "fact_ids")


_OWN = "list_filter({0}, lambda x: NOT list_contains(string_split(norm, ' '), x))"


_BRIDGES = f"""{_FA},\n{_PHRASES},
cf AS (SELECT fact_id, page_start AS page, {_CONTENT.format('text')} AS c FROM fa), ex AS (SELECT norm, unnest(fact_ids) AS fact_a, fact_ids FROM bg), pr AS (SELECT norm, fact_a, unnest(fact_ids) AS fact_b FROM ex),
sc AS (SELECT norm, fact_a, fact_b, {_OWN.format('a.c')} AS x, {_OWN.format('b.c')} AS y FROM pr JOIN cf a ON a.fact_id = fact_a JOIN cf b ON b.fact_id = fact_b WHERE fact_a < fact_b AND a.page <> b.page),
jo AS (SELECT *, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0.0 END, 6) AS overlap FROM sc)
SELECT fact_a, fact_b, max_by(norm, (length(norm), norm)) AS norm, max_by(overlap, (length(norm), norm)) AS overlap FROM jo WHERE overlap < 0.6::DOUBLE GROUP BY 1, 2"""


@q("gr_bridge_pairs", _BRIDGES)
def gr_bridge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.bridge_pairs(_facts(spark, d))


_ROLE = _case("text", P.ROLES, "'definition'")
_BONUS = "CASE " + " ".join(f"WHEN a.role = '{x}' AND b.role = '{y}' THEN {v}::DOUBLE" for (x, y), v in reversed(list(G.ROLE_BONUS.items()))) + " WHEN a.role <> b.role THEN 0.03::DOUBLE ELSE 0 END"
_PAIRS = f"""nf AS (SELECT doc_id, order_idx, fact_id, page_start AS page, text, {_CONTENT.format('text')} AS c, {_ROLE} AS role FROM fa),
np AS (SELECT a.doc_id, a.fact_id AS fact_a, b.fact_id AS fact_b, b.order_idx - a.order_idx AS distance, a.page AS page_a, b.page AS page_b, a.role AS role_a, b.role AS role_b, a.text AS ta, b.text AS tb,
  len(list_intersect(a.c, b.c))::DOUBLE / greatest(1, least(len(a.c), len(b.c))) AS sh, {_BONUS} AS rb, CASE WHEN regexp_matches(a.text, '{G.CONDITION_CUE}') AND regexp_matches(b.text, '{G.OUTCOME_CUE}') THEN 0.10::DOUBLE ELSE 0 END AS di
  FROM nf a JOIN nf b ON a.doc_id = b.doc_id AND b.order_idx BETWEEN a.order_idx + 1 AND a.order_idx + 3),
ns AS (SELECT doc_id, fact_a, fact_b, distance, page_a, page_b, role_a, role_b, round(sh, 6) AS shared, round(least(0.08::DOUBLE, sh * 0.08::DOUBLE) + rb + di, 6) AS score FROM np)"""


@q("gr_neighbour_pairs", f"{_FA},\n{_PAIRS}\nSELECT * FROM ns")
def gr_neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbour_pairs(_facts(spark, d))


_BAND = "nb AS (SELECT f, list(c ORDER BY distance, later) AS cs FROM (SELECT fact_a AS f, fact_b AS c, distance, 1 AS later, page_a, page_b, shared FROM ns UNION ALL SELECT fact_b, fact_a, distance, 0, page_a, page_b, shared FROM ns) WHERE page_a = page_b AND shared >= 0.1::DOUBLE AND shared < 0.8::DOUBLE GROUP BY 1)"


@q("gr_clusters", f"""{_FA},\n{_PAIRS},\n{_BAND},\nbp AS ({_BRIDGES.replace(_FA, 'WITH zz AS (SELECT 1)', 1)}),
c1 AS (SELECT fact_a, fact_b, list_filter(a.cs, lambda x: x <> fact_a AND x <> fact_b)[1] AS a2, b.cs AS bcs FROM bp LEFT JOIN nb a ON a.f = fact_a LEFT JOIN nb b ON b.f = fact_b), c2 AS (SELECT fact_a, fact_b, a2, list_filter(bcs, lambda x: x <> fact_a AND x <> fact_b AND x <> coalesce(a2, ''))[1] AS b2 FROM c1)
SELECT fact_a, CASE WHEN b2 IS NOT NULL THEN a2 END AS fact_a2, fact_b, CASE WHEN a2 IS NOT NULL THEN b2 END AS fact_b2, CASE WHEN a2 IS NOT NULL AND b2 IS NOT NULL THEN 'cluster_2plus2' ELSE 'pair' END AS kind FROM c2""")
def gr_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Bridge pairs grown to clusters of four by the nearest fact in band of either side."""
    f = _facts(spark, d)
    return G.clusters(G.bridge_pairs(f), G.nearest_in_band(G.neighbour_pairs(f)))


_SCHED = "s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_a ORDER BY score DESC, fact_b) AS r1 FROM ns) WHERE r1 <= 2), s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_a, page_b ORDER BY score DESC, fact_a, fact_b) AS r2 FROM s1) WHERE r2 <= 24)"


@q("gr_scheduled_pairs", f"{_FA},\n{_PAIRS},\n{_SCHED}\nSELECT fact_a, fact_b, score FROM s2")
def gr_scheduled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.schedule(G.neighbour_pairs(_facts(spark, d))).select("fact_a", "fact_b", "score")


@q("gr_schedule_report", f"{_FA},\n{_PAIRS},\n{_SCHED}\nSELECT doc_id, count(*) AS n_pairs, count(DISTINCT fact_a) AS n_anchors, count(DISTINCT page_a) AS n_pages, count_if(coalesce(page_a // 10 <> page_b // 10, false)) AS n_across_tens FROM s2 GROUP BY 1")
def gr_schedule_report(spark: SparkSession, d: str) -> DataFrame:
    s = G.schedule(G.neighbour_pairs(_facts(spark, d)))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("fact_a").alias("n_anchors"), F.countDistinct("page_a").alias("n_pages"), F.count_if(F.expr("page_a div 10 <> page_b div 10")).alias("n_across_tens"))


@q("gr_prefilter_reasons", f"{_FA},\n{_PAIRS}\nSELECT coalesce(CASE WHEN shared >= 0.8::DOUBLE THEN 'near_duplicate_fact_text' WHEN coalesce(abs(page_a - page_b), 0) > 5 AND shared < 0.1::DOUBLE THEN 'page_gap_outlier_combined' WHEN shared < 0.1::DOUBLE AND score < 0.05::DOUBLE THEN 'weak_bridge' END, 'kept') AS reason, count(*) AS n FROM ns GROUP BY 1")
def gr_prefilter_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = G.neighbour_pairs(_facts(spark, d))
    return p.groupBy(F.coalesce(G.prefilter_reason(p), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q("gr_edge_acceptance", f"{_FA},\n{_PAIRS}\nSELECT role_a, role_b, count(*) AS n, count_if(round(0.40::DOUBLE * shared + 0.25::DOUBLE * score + 0.35::DOUBLE / distance, 6) >= 0.30::DOUBLE) AS n_accepted FROM ns GROUP BY 1, 2")
def gr_edge_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Edges accepted by the weighted sum of their scores, by pair of roles."""
    w = F.round(0.40 * F.col("shared") + 0.25 * F.col("score") + 0.35 / F.col("distance"), 6)
    return G.neighbour_pairs(_facts(spark, d)).groupBy("role_a", "role_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(w >= 0.30).alias("n_accepted"))


@q("gr_paths", f"{_FA},\n{_PAIRS},\n{_SCHED},\np3 AS (SELECT [a.fact_a, a.fact_b, b.fact_b] AS path, round(a.score * b.score, 6) AS weight FROM s2 a JOIN s2 b ON b.fact_a = a.fact_b WHERE b.fact_b <> a.fact_a)\nSELECT path, weight FROM (SELECT *, row_number() OVER (PARTITION BY path[1] ORDER BY weight DESC, array_to_string(path, '|')) AS r FROM p3) WHERE r <= 2")
def gr_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.paths(G.schedule(G.neighbour_pairs(_facts(spark, d))))


_SW = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"
_CLEAN = rf"1 - CASE WHEN t = '' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN regexp_matches(t, '{C.EQUATION}') THEN 0.65::DOUBLE ELSE 0 END + least(0.5::DOUBLE, len(regexp_extract_all(t, '{C.MATH}')) * 0.12::DOUBLE) + least(0.45::DOUBLE, len(regexp_extract_all(t, '{C.SYMBOLS}'))::DOUBLE / greatest(length(t), 1) * 10)) END"
_FEATURES = f"""ff AS (SELECT doc_id, order_idx, fact_id, chunk_id, page_start, char_start, {_ROLE} AS role, length(trim(text, ' ')) AS n, lower(t) AS norm, ({_STRICT}) IS NOT NULL AS fragment, {_CLEAN} AS clean, least(1.0::DOUBLE, len(regexp_extract_all(text, '{C.ACTION}')) / 2.0::DOUBLE) AS action,
  list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}')), lambda w: NOT list_contains({_SW}, w)) AS words, {_CONTENT.format('text')} AS content, regexp_matches(text, '{C.UNRESOLVED}') AS unresolved, regexp_matches(text, '{C.CONDITION_CUE}') AS cond, regexp_matches(text, '{C.SETUP_CUE}') AS setup,
  regexp_matches(t, '{P.DEICTIC_OPENER}') AS deictic, regexp_matches(t, '{C.WEAK_START}') AS weak FROM {_plain('(SELECT fa.*, ch.char_start FROM fa JOIN ch USING (chunk_id))', ', *')})"""
_MED = "me AS (SELECT doc_id, greatest(1.0::DOUBLE, median(n)) AS med FROM ff GROUP BY 1)"
_PICK = lambda key, values, other: "CASE " + " ".join(f"WHEN {key} = '{k if isinstance(k, str) else '|'.join(k)}' THEN {v}::DOUBLE" for k, v in reversed(list(values.items()))) + f" ELSE {other} END"
_01 = lambda c: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))"
_SIGNALS = {
    "length": _01("(a.n + b.n) / 2.0::DOUBLE / med"),
    "fragment": "1 - (a.fragment::INT + b.fragment::INT) / 2.0::DOUBLE",
    "page_compactness": f"1 - {_01(f'coalesce(abs(a.page_start - b.page_start), 0) / {C.MAX_PAGE_GAP}::DOUBLE')}",
    "role_variety": "CASE WHEN a.role = b.role THEN 0.5 ELSE 1.0 END",
    "lexical_bridge": "CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN len(list_intersect(a.words, b.words))::DOUBLE / least(len(a.words), len(b.words)) ELSE 0.0 END",
    "typed_edge_confidence": "CASE WHEN a.role <> b.role THEN shared ELSE 0.0 END",
    "edge_joint_only_margin": _01("score"),
    "answer_contribution_score": "1.0::DOUBLE / distance",
    "relation_type_strength": _PICK("ty", C.STRENGTH, C.UNKNOWN_RELATION),
    "source_text_quality": "ql",
    "compositional_actionability": _01(f"(0.28::DOUBLE * {_PICK('ty', C.ACTIONABLE, C.UNKNOWN_RELATION)} + 0.18::DOUBLE * {_PICK('rp', C.ACTIONABLE_ROLES, 'CASE WHEN a.role <> b.role THEN 0.58::DOUBLE ELSE 0.42::DOUBLE END')} + 0.2::DOUBLE * {_01('score')} + 0.18::DOUBLE * (a.action + b.action) / 2) * (0.7::DOUBLE + 0.3::DOUBLE * ql) - 0.14::DOUBLE * (ty = 'definition' AND a.role = 'definition' AND b.role = 'definition')::INT - {_01('0.18::DOUBLE * (a.unresolved::INT + b.unresolved::INT)')}"),
    "multi_hop_questionability": _01(
        f"""{_01(f"{_PICK('rp', C.QUESTIONABLE_ROLES, 'CASE WHEN a.role <> b.role THEN 0.5::DOUBLE ELSE 0.34::DOUBLE END')} + CASE WHEN b.role = 'condition' AND b.cond THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN a.role = 'condition' AND a.cond THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN a.role = 'definition' AND a.setup THEN 0.08::DOUBLE ELSE 0 END + {_PICK('ty', C.RELATION_BONUS, C.OTHER_BONUS)} - CASE WHEN ty IN ('definition', 'descriptive') AND a.role = 'definition' AND b.role = 'definition' THEN 0.18::DOUBLE ELSE 0 END")} * (0.75::DOUBLE + 0.25::DOUBLE * ql)"""
    ),
}
_PASS1 = " + ".join(f"{k} * {w}::DOUBLE" for k, w in C.WEIGHTS.items())
_SCORED = f"""{_FEATURES},\n{_MED},
sg AS (SELECT doc_id, fact_a, fact_b, shared, ta, {', '.join(f'round({x} + 1e-9, 6) AS {k}' for k, x in _SIGNALS.items())}, CASE WHEN a_role <> b_role THEN 'typed_mh' ELSE 'untyped_mh' END AS category FROM
  (SELECT s2.*, a, b, med, a.role AS a_role, b.role AS b_role, '' AS ta, CASE WHEN a.role <> b.role THEN b.role ELSE 'descriptive' END AS ty, a.role || '|' || b.role AS rp, {_01('(a.clean + b.clean) / 2')} AS ql FROM s2 JOIN ff a ON a.fact_id = s2.fact_a JOIN ff b ON b.fact_id = s2.fact_b JOIN me ON me.doc_id = s2.doc_id)),
sc AS (SELECT *, round({_01(f'({_PASS1}) / {sum(C.WEIGHTS.values())}::DOUBLE')} + 1e-9, 6) AS pass1 FROM sg),
fi AS (SELECT *, CASE WHEN reranked THEN round({_01(f'pass1 * {1 - C.SECOND_SHARE}::DOUBLE + shared * {C.SECOND_SHARE}::DOUBLE')} + 1e-9, 6) ELSE pass1 END AS final FROM (SELECT *, pass1 >= {C.MIN_PASS1}::DOUBLE AND row_number() OVER (PARTITION BY doc_id ORDER BY pass1 DESC, fact_a, fact_b) <= 12 AS reranked FROM sc))"""
_FACH = with_("fa ch", "").rstrip()


def _features(spark: SparkSession, d: str) -> DataFrame:
    at = V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "char_start")
    return C.fact_features(_facts(spark, d).join(at, "chunk_id"))


def pair_chains(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, fact_a, fact_b, shared, facts, edges, median: the scheduled pairs as chains of two facts.

    An edge between facts of different roles is typed by the second role; what the pair shares stands for the confidence in
    it, its score for the margin, and the closer the facts the more either adds.
    """
    f = _features(spark, d)
    median = f.groupBy("f.doc_id").agg(F.median("f.n").alias("median"))
    p = G.schedule(G.neighbour_pairs(_facts(spark, d)))
    differ = F.col("role_a") != F.col("role_b")
    edge = F.struct(F.when(differ, F.col("role_b")).otherwise("descriptive").alias("type"), differ.alias("typed"), F.col("shared").alias("confidence"), F.col("score").alias("margin"), (1 / F.col("distance")).alias("contribution"), F.lit(0.0).alias("action"))
    p = p.select("doc_id", "fact_a", "fact_b", "shared", F.array(edge).alias("edges")).join(median, "doc_id")
    both = p.join(f.toDF("fact_a", "a"), "fact_a").join(f.toDF("fact_b", "b"), "fact_b")
    return both.select("doc_id", "fact_a", "fact_b", "shared", F.array("a", "b").alias("facts"), "edges", "median")


@q("gr_chain_scores", f"{_FACH},\n{_PAIRS},\n{_SCHED},\n{_SCORED}\nSELECT fact_a, fact_b, {', '.join(C.WEIGHTS)}, pass1, category FROM fi")
def gr_chain_scores(spark: SparkSession, d: str) -> DataFrame:
    """Chains of two facts with all twelve signals, their weighted mean and their category."""
    return C.score(pair_chains(spark, d)).select("fact_a", "fact_b", *C.WEIGHTS, "pass1", "category")


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    return C.second_pass(C.score(pair_chains(spark, d)), F.col("shared"), ["doc_id"], ["fact_a", "fact_b"], 8)


@q("gr_chain_rerank", f"{_FACH},\n{_PAIRS},\n{_SCHED},\n{_SCORED}\nSELECT fact_a, fact_b, reranked, final, final >= {C.MIN_FINAL}::DOUBLE AS kept FROM fi")
def gr_chain_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best twelve chains of each document scored a second time, by what their facts share."""
    return _reranked(spark, d).select("fact_a", "fact_b", "reranked", "final", "kept")


@q("gr_score_histogram", f"{_FACH},\n{_PAIRS},\n{_SCHED},\n{_SCORED}\nSELECT least(9, floor(final * 10))::INT AS bin, category, count(*) AS n, count_if(reranked) AS n_reranked, count_if(final >= {C.MIN_FINAL}::DOUBLE) AS n_kept FROM fi GROUP BY 1, 2")
def gr_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("final") * 10)).cast("int").alias("bin"), "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("reranked").alias("n_reranked"), F.count_if("kept").alias("n_kept"))


_REASON = f"""CASE WHEN a.norm = b.norm THEN 'duplicate_fact_text' WHEN a.chunk_id = b.chunk_id THEN 'insufficient_distinct_chunks' WHEN a.role = b.role THEN 'insufficient_distinct_roles' WHEN (a.page_start IS NOT NULL OR b.page_start IS NOT NULL) AND coalesce(a.page_start = b.page_start, true) THEN 'insufficient_distinct_pages'
  WHEN coalesce(abs(a.char_start - b.char_start), 0) < 200 THEN 'insufficient_char_gap' WHEN a.weak OR b.weak THEN 'chain_quality:weak_context_fragment' WHEN abs(a.page_start - b.page_start) > {C.MAX_PAGE_GAP} THEN 'chain_quality:source_gap_too_large' WHEN len(a.content) = 0 OR len(b.content) = 0 THEN 'chain_quality:empty_fact_terms'
  WHEN len(list_intersect(a.content, b.content)) < 1 THEN 'chain_quality:unconnected_fact' WHEN a.deictic OR b.deictic THEN 'deictic_opener_unresolved' ELSE 'kept' END"""


@q("gr_chain_filter", f"{_FACH},\n{_PAIRS},\n{_SCHED},\n{_FEATURES}\nSELECT {_REASON} AS reason, count(*) AS n FROM s2 JOIN ff a ON a.fact_id = fact_a JOIN ff b ON b.fact_id = fact_b GROUP BY 1")
def gr_chain_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chains by the first rule they break: two chunks, roles and pages, 200 characters apart."""
    reason = C.filter_reason(F.col("facts"), chunks=2, roles=2, pages=2, char_gap=200)
    return pair_chains(spark, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q("dd_yield")
def dd_yield(spark: SparkSession, d: str) -> DataFrame:
    """Per document what its chains yield when tried in order of their score, up to a target of 5 and 20 attempts; a kept chain is a good one."""
    r = _reranked(spark, d).select("doc_id", "category", F.col("kept").alias("good"), (-F.col("final")).alias("rank"), "fact_a", "fact_b")
    tried = C.yields(r, "doc_id", 5, 20, ["rank", "fact_a", "fact_b"])
    return tried.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if("accepted").alias("n_accepted"), F.count_if(F.col("accepted") & (F.col("category") == "typed_mh")).alias("n_typed"))


@q("gr_greedy_chains", f"{_FA},\n{_PAIRS},\nbn AS (SELECT fact_a, max_by(fact_b, (score, -distance)) AS fact_b FROM ns GROUP BY 1)\nSELECT a.fact_a AS start, list_filter([a.fact_a, a.fact_b, b.fact_b, c.fact_b], lambda x: x IS NOT NULL) AS path FROM bn a LEFT JOIN bn b ON b.fact_a = a.fact_b LEFT JOIN bn c ON c.fact_a = b.fact_b")
def gr_greedy_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to four facts, each the best next of the one before."""
    return G.greedy_chains(G.neighbour_pairs(_facts(spark, d)))


@q("gr_distractors", f"{_FA},\n{_PAIRS}\nSELECT fact_b AS distractor, min_by(fact_a, (-shared, fact_a)) AS fact_id FROM ns WHERE page_a <> page_b AND shared BETWEEN 0.1::DOUBLE AND 0.6::DOUBLE GROUP BY 1")
def gr_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Facts off the page that share something with another; each serves the one it is nearest to, once."""
    p = G.neighbour_pairs(_facts(spark, d)).filter((F.col("page_a") != F.col("page_b")) & F.col("shared").between(0.1, 0.6))
    return p.groupBy(F.col("fact_b").alias("distractor")).agg(F.min_by("fact_a", F.struct(-F.col("shared"), "fact_a")).alias("fact_id"))


@q("gr_page_gap_pairs", f"{_FA},\n{_PAIRS}\nSELECT fact_a, fact_b, abs(page_a - page_b) AS gap FROM ns WHERE page_a IS NOT NULL AND page_b IS NOT NULL AND shared > 0 ORDER BY gap DESC, fact_a, fact_b LIMIT 30")
def gr_page_gap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = G.neighbour_pairs(_facts(spark, d)).filter("page_a is not null and page_b is not null and shared > 0")
    return p.select("fact_a", "fact_b", F.abs(F.col("page_a") - F.col("page_b")).alias("gap")).orderBy(F.desc("gap"), "fact_a", "fact_b").limit(30)
