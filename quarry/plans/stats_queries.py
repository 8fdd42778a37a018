"""Queries on statistics, duplicates, budgets and verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import text as T
from quarry.functions import views as V
from quarry.operators import dedup as D
from quarry.operators import verify as Y
from quarry.functions import pair_checks as C
from quarry.plans.filter_queries import _SCORED, _case, with_evidence
from quarry.plans.named import register
from quarry.plans.oracle import tok, with_
from quarry.plans.retrieval_queries import _rel, _rel_sql
from quarry.session import table

QUERIES, SQL, q = register()


_RP = "rp AS (SELECT q_id, mode, len(rel)::DOUBLE / n_gold AS r, len(rel)::DOUBLE / n AS p FROM rl)"


def _rp(spark: SparkSession, d: str) -> DataFrame:
    return _rel(spark, d).select("ret_id", "q_id", "mode", (F.size("rel") / F.col("n_gold")).alias("r"), (F.size("rel") / F.col("n")).alias("p"))


@q("ag_spread", _rel_sql("").rstrip() + f",\n{_RP}\nSELECT mode, count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(stddev_pop(r), 6) AS sd_pop, round(stddev_samp(r), 6) AS sd_samp, count_if(r = 0) AS n_zero, count_if(r = 1) AS n_full FROM rp GROUP BY 1")
def ag_spread(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r")
    return _rp(spark, d).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.percentile(r, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop(r), 6).alias("sd_pop"), F.round(F.stddev_samp(r), 6).alias("sd_samp"), F.count_if(r == 0).alias("n_zero"), F.count_if(r == 1).alias("n_full"))


#: Resamples, and groups of questions that are drawn together once there are more questions than groups.
RESAMPLES, CELLS = 1000, 4096
# The Poisson distribution of mean 1, times 2^32.
POISSON = tuple(int(x * 2**32) for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975))
_MIX = "({0} * 73244475) % 4294967296"
_U = _MIX.format("xor({0}, {0} >> 16)")


@q("ag_bootstrap", _rel_sql("").rstrip() + f""",\n{_RP}, mq AS (SELECT mode, q_id, avg(r) AS v FROM rp GROUP BY 1, 2), ce AS (SELECT mode, ('0x' || md5(q_id)[1:8])::BIGINT % {CELLS} AS cell, sum(v) AS s, count(*) AS n FROM mq GROUP BY 1, 2),
hx AS (SELECT *, {_U.format('x1')} AS x2 FROM (SELECT *, {_U.format('x0')} AS x1 FROM (SELECT mode, s, n, b, cell * 1000003 + b * 7919 + 12345 AS x0 FROM ce, range({RESAMPLES}) t(b)))),
wt AS (SELECT mode, s, n, b, {' + '.join(f'(xor(x2, x2 >> 16) >= {x})::INT' for x in POISSON)} AS w FROM hx), bs AS (SELECT mode, b, sum(s * w) / sum(n * w) AS m FROM wt GROUP BY 1, 2 HAVING sum(n * w) > 0)
SELECT mode, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.975), 5) AS hi FROM bs GROUP BY 1""")
def ag_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of the mean over RESAMPLES resamples, which draw every question a Poisson number of times (mean 1).

    The draws come from a hash, so runs agree. Questions are drawn in CELLS groups by a hash of their id, so the work has a
    bound however many there are; with fewer questions than groups most are drawn alone.
    """
    cell = F.conv(F.substring(F.md5("q_id"), 1, 8), 16, 10).cast("long") % CELLS
    m = _rp(spark, d).groupBy("mode", "q_id").agg(F.avg("r").alias("v")).groupBy("mode", cell.alias("cell")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    x = m.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1)))).withColumn("x", F.col("cell") * 1000003 + F.col("b") * 7919 + 12345)
    for _ in range(2):
        x = x.withColumn("x", (F.col("x").bitwiseXOR(F.shiftright("x", 16)) * 73244475) % 4294967296)
    u = F.col("x").bitwiseXOR(F.shiftright("x", 16))
    w = sum(((u >= t).cast("int") for t in POISSON), F.lit(0))
    bs = x.withColumn("w", w).groupBy("mode", "b").agg(F.sum(F.col("s") * F.col("w")).alias("s"), F.sum(F.col("n") * F.col("w")).alias("n")).filter("n > 0").withColumn("m", F.col("s") / F.col("n"))
    return bs.groupBy("mode").agg(F.round(F.percentile("m", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 5).alias("hi"))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.round(F.stddev_pop(x), 9) > 0) & (F.round(F.stddev_pop(y), 9) > 0), F.round(F.try_divide(F.covar_pop(x, y), spread), 6))


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN round(stddev_pop({x}), 9) > 0 AND round(stddev_pop({y}), 9) > 0 THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END"


@q("ag_pearson", _rel_sql("").rstrip() + f",\n{_RP}\nSELECT mode, {_corr('r', 'p')} AS rho FROM rp GROUP BY 1")
def ag_pearson(spark: SparkSession, d: str) -> DataFrame:
    return _rp(spark, d).groupBy("mode").agg(pearson("r", "p").alias("rho"))


_QM = "qm AS (SELECT q_id, round(avg(r), 9) AS r, round(avg(p), 9) AS p FROM rp GROUP BY 1)"


def _average_rank(rows: DataFrame, value: str) -> DataFrame:
    """value and its average rank over all rows: counts per value, then a running sum over the distinct values only."""
    c = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(value, (before + (F.col("c") + 1) / 2).alias(f"rank_{value}"))


@q("ag_spearman", _rel_sql("").rstrip() + f",\n{_RP}, {_QM}\nSELECT count(*) AS n, {_corr('a', 'b')} AS rho FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS b FROM qm)")
def ag_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with average ranks. Only the distinct values are ordered in one place, never the rows."""
    m = _rp(spark, d).groupBy("q_id").agg(F.round(F.avg("r"), 9).alias("r"), F.round(F.avg("p"), 9).alias("p"))
    both = m.join(_average_rank(m, "r"), "r").join(_average_rank(m, "p"), "p")
    return both.agg(F.count(F.lit(1)).alias("n"), pearson("rank_r", "rank_p").alias("rho"))


@q("ag_kendall", _rel_sql("").rstrip() + f""",\n{_RP}, dm AS (SELECT q_id, round(round(avg(r), 9) * 1000, 0)::INT AS r, round(round(avg(p), 9) * 1000, 0)::INT AS p FROM rp GROUP BY 1), pa AS (SELECT sign(a.r - b.r) AS x, sign(a.p - b.p) AS y FROM dm a JOIN dm b ON a.q_id < b.q_id)
SELECT (SELECT count(*) FROM dm) AS n, CASE WHEN sum(abs(x)) > 0 AND sum(abs(y)) > 0 THEN round(sum(x * y) / sqrt(sum(abs(x))::DOUBLE * sum(abs(y))::DOUBLE), 6) END AS tau FROM pa""")
def ag_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Tau (b, ties counted out) of the questions' mean recall and precision, to three places; null where one doesn't vary.

    Exact over all questions: they are counted by value, of which there are at most 1,001 x 1,001, and pairs of values are
    counted by sums over that grid, never pair by pair.
    """

    @F.pandas_udf("struct<n:bigint,tau:double>")
    def tau(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kendall([(c["r"], c["p"], c["c"]) for c in x]) for x in cells], columns=["n", "tau"])

    m = _rp(spark, d).groupBy("q_id").agg(F.round(F.round(F.avg("r"), 9) * 1000, 0).cast("int").alias("r"), F.round(F.round(F.avg("p"), 9) * 1000, 0).cast("int").alias("p"))
    cells = m.groupBy("r", "p").agg(F.count(F.lit(1)).alias("c")).agg(F.collect_list(F.struct("r", "p", "c")).alias("cells"))
    return cells.select(tau("cells").alias("t")).select("t.n", "t.tau")


def kendall(cells: list[tuple[int, int, int]]) -> tuple[int, float | None]:
    """The number of rows and tau b of rows counted by their two values, (x, y, rows)."""
    if not cells:
        return 0, None
    x, y, c = (np.array(v) for v in zip(*cells))
    (_, i), (_, j) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    grid = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(grid, (i, j), c)
    n, below = grid.sum(), np.cumsum(grid, axis=0) - grid  # rows of smaller x with each y
    left = np.cumsum(below, axis=1) - below
    agree, against = (grid * left).sum(), (grid * (below.sum(axis=1, keepdims=True) - left - below)).sum()
    pairs = lambda k: (k * (k - 1) / 2).sum()
    a, b = pairs(n) - pairs(grid.sum(axis=1)), pairs(n) - pairs(grid.sum(axis=0))
    return int(n), round(float((agree - against) / np.sqrt(a * b)), 6) if a and b else None


@q("ag_difficulty_matrix", _rel_sql("").rstrip() + f",\n{_RP}\nSELECT coalesce(hop_type, 'all') AS hop_type, coalesce(depth, -1) AS depth, count(*) AS n, round(avg(r), 6) AS recall FROM (SELECT r, hop_type, least(len(gold_chunk_ids), 3)::INT AS depth FROM rp JOIN qu USING (q_id)) GROUP BY CUBE (hop_type, depth)")
def ag_difficulty_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Recall by hop type and number of evidence chunks, with all margins."""
    u = V.questions(table(spark, d, "questions")).select("q_id", "hop_type", F.least(F.size("gold_chunk_ids"), F.lit(3)).alias("depth"))
    c = _rp(spark, d).join(u, "q_id").cube("hop_type", "depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("recall"))
    return c.select(F.coalesce("hop_type", F.lit("all")).alias("hop_type"), F.coalesce("depth", F.lit(-1)).alias("depth"), "n", "recall")


@q("ag_cost_rollup", "SELECT coalesce(user_id, -1) AS run, coalesce(event_type, 'all') AS stage, count(*) AS n, round(sum(value), 2) AS cost, ceil(sum(length(props)) / 3.5::DOUBLE)::BIGINT AS tokens FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id))")
def ag_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Costs in all, by stage and by run; tokens by the length of the payload."""
    e = table(spark, d, "events")
    a = (F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"), F.ceil(F.sum(F.length("props")) / 3.5).alias("tokens"))
    r = e.groupingSets([[], [F.col("event_type")], [F.col("user_id")]], F.col("event_type"), F.col("user_id")).agg(*a)
    return r.select(F.coalesce("user_id", F.lit(-1)).alias("run"), F.coalesce("event_type", F.lit("all")).alias("stage"), "n", "cost", "tokens")


@q("ag_cost_ratios", "SELECT event_type, round(sum(value) / nullif(count(DISTINCT user_id), 0), 4) AS per_run, round(sum(value) / nullif(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END), 0), 4) AS per_negative FROM events GROUP BY 1")
def ag_cost_ratios(spark: SparkSession, d: str) -> DataFrame:
    s = F.sum("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(s / F.nullif(F.count_distinct("user_id"), F.lit(0)), 4).alias("per_run"), F.round(s / F.nullif(F.count_if(F.col("value") < 0), F.lit(0)), 4).alias("per_negative"))


_MEANS = [f"round(avg({k}::INT), 6) AS {k}" for k in C.WEIGHTS]


@q("ag_quality_histogram", with_("qu go ch", f"SELECT floor(quality * 10)::INT AS bin, count(*) AS n, count_if({' OR '.join(C.HARD)}) AS n_hard, {', '.join(_MEANS)} FROM ({_SCORED}) GROUP BY 1"))
def ag_quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by quality, and in each bin the share that each check fired on."""
    f = C.checked(with_evidence(spark, d))
    hard = F.greatest(*(F.col(k) for k in C.HARD))
    return f.groupBy(F.floor(F.col("quality") * 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hard).alias("n_hard"), *(F.round(F.avg(F.col(k).cast("int")), 6).alias(k) for k in C.WEIGHTS))


@q("ag_deltas", with_("rk", "SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.n, 0) AS n_bm25, coalesce(b.n, 0) AS n_dense, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT q_id, count(*) AS n FROM rk WHERE mode = 'bm25' GROUP BY 1) a FULL JOIN (SELECT q_id, count(*) AS n FROM rk WHERE mode = 'dense' GROUP BY 1) b ON a.q_id = b.q_id"))
def ag_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Two configurations side by side per question, missing ones as zero."""
    n = V.ranked(table(spark, d, "retrievals")).filter("mode in ('bm25', 'dense')").groupBy("q_id").pivot("mode", ["bm25", "dense"]).count().fillna(0)
    return n.select("q_id", F.col("bm25").alias("n_bm25"), F.col("dense").alias("n_dense"), (F.col("dense") - F.col("bm25")).alias("delta"))


@q("ag_summary", with_("qu", f"SELECT hop_type, count(*) AS n, count(question) - count(DISTINCT trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'))) AS n_repeated, round(avg(len(gold_chunk_ids)), 6) AS mean_evidence, round(avg(len({tok('answer')})), 6) AS mean_answer_tokens FROM qu GROUP BY 1"))
def ag_summary(spark: SparkSession, d: str) -> DataFrame:
    u = V.questions(table(spark, d, "questions"))
    return u.groupBy("hop_type").agg(F.count(F.lit(1)).alias("n"), (F.count("question") - F.count_distinct(T.dedup_key(F.col("question")))).alias("n_repeated"), F.round(F.avg(F.when(F.col("gold_chunk_ids").isNotNull(), F.size("gold_chunk_ids"))), 6).alias("mean_evidence"), F.round(F.avg(F.when(F.col("answer").isNotNull(), F.size(T.tokens(F.col("answer"))))), 6).alias("mean_answer_tokens"))


@q("ag_evidence_sets", with_("go ch", "SELECT q_id, list_sort(list(DISTINCT doc_id)) AS docs, list_sort(list(DISTINCT page_start) FILTER (page_start IS NOT NULL)) AS pages, count(DISTINCT chunk_id) AS n_chunks, coalesce(max(char_start) - min(char_start), 0) AS char_gap FROM go JOIN ch USING (chunk_id) GROUP BY 1").replace("list_sort(list(DISTINCT page_start) FILTER (page_start IS NOT NULL)) AS pages", "coalesce(list_sort(list(DISTINCT page_start) FILTER (page_start IS NOT NULL)), []) AS pages"))
def ag_evidence_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents, pages and chunks of each question's evidence, and how far apart it lies."""
    r = V.gold(table(spark, d, "questions")).join(V.chunk_rows(table(spark, d, "chunks")), "chunk_id")
    return r.groupBy("q_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"), F.array_sort(F.collect_set("page_start")).alias("pages"), F.count_distinct("chunk_id").alias("n_chunks"), F.coalesce(F.max("char_start") - F.min("char_start"), F.lit(0)).alias("char_gap"))


@q("ag_funnel", with_("fa", f"SELECT doc_id, count(*) AS n, count_if(length(text) >= 60) AS n_long, count_if(length(text) >= 60 AND {_case('text', P.ROLES, 'NULL')} IS NOT NULL) AS n_typed FROM fa GROUP BY 1"))
def ag_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many facts of each document pass each step."""
    f = V.facts(table(spark, d, "chunks"))
    typed = P.first_match(F.col("text"), P.ROLES, None).isNotNull()
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") >= 60).alias("n_long"), F.count_if((F.length("text") >= 60) & typed).alias("n_typed"))


@q("ag_drop_pivot", with_("qu go ch", f"SELECT hop_type, {', '.join(f'count_if({k}) AS {k}' for k in C.WEIGHTS)}, count_if(quality > 0) AS kept FROM ({_SCORED}) GROUP BY 1"))
def ag_drop_pivot(spark: SparkSession, d: str) -> DataFrame:
    f = C.checked(with_evidence(spark, d))
    return f.groupBy("hop_type").agg(*(F.count_if(k).alias(k) for k in C.WEIGHTS), F.count_if(F.col("quality") > 0).alias("kept"))


@q("ag_tpch_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def ag_tpch_pricing(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter("l_shipdate <= date '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


_EVK = "ek AS (SELECT q_id, doc_id, question, answer, list_sort(list_distinct(gold_chunk_ids)) AS k, length(coalesce(answer, '')) AS n FROM qu)"


@q("dd_shared_evidence", with_("qu", "").rstrip() + f",\n{_EVK}\nSELECT q_id FROM (SELECT q_id, k, row_number() OVER (PARTITION BY doc_id, k ORDER BY n DESC, q_id) AS r FROM ek) WHERE r = 1 OR k IS NULL OR len(k) = 0")
def dd_shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of questions with the same evidence in a document the one with most answer stays; those without evidence all stay."""
    u = V.questions(table(spark, d, "questions")).withColumn("k", F.array_sort(F.array_distinct("gold_chunk_ids"))).withColumn("n", F.length(F.coalesce("answer", F.lit(""))))
    none = F.col("k").isNull() | (F.size("k") == 0)
    return D.first_of(u.filter(~none), ["doc_id", "k"], [F.desc("n"), F.col("q_id")]).select("q_id").unionByName(u.filter(none).select("q_id"))


@q("dd_exact_questions", with_("qu", "SELECT min(q_id) AS q_id, count(*) - 1 AS n_dropped FROM qu WHERE question IS NOT NULL GROUP BY trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'))"))
def dd_exact_questions(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(table(spark, d, "questions")).filter("question is not null").groupBy(T.dedup_key(F.col("question")).alias("k")).agg(F.min("q_id").alias("q_id"), (F.count(F.lit(1)) - 1).alias("n_dropped")).select("q_id", "n_dropped")


@q("dd_greedy_questions")
def dd_greedy_questions(spark: SparkSession, d: str) -> DataFrame:
    u = V.questions(table(spark, d, "questions")).filter("question is not null").select("doc_id", "q_id", F.array_distinct(T.tokens(F.col("question"))).alias("t"), F.length(F.coalesce("answer", F.lit(""))).alias("n"))
    return D.greedy_unlike(u, "doc_id", "q_id", "t", "n", 0.8)


_ALLOC = """c AS (SELECT doc_id, count(*) AS n FROM qu GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), b AS (SELECT doc_id, n, total, 250.0::DOUBLE * n / greatest(total, 1) AS quota, CASE WHEN 250 >= total THEN n ELSE least(n, floor(250.0::DOUBLE * n / greatest(total, 1)))::BIGINT END AS base FROM c, t),
s AS (SELECT least(250, max(total)) - sum(base) AS spare FROM b), o AS (SELECT doc_id, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, n DESC, doc_id DESC) AS r FROM b WHERE base < n)"""


@q("dd_allocate", with_("qu", "").rstrip() + f",\n{_ALLOC}\nSELECT doc_id, n, (base + CASE WHEN r <= spare THEN 1 ELSE 0 END)::BIGINT AS alloc FROM b LEFT JOIN o USING (doc_id), s")
def dd_allocate(spark: SparkSession, d: str) -> DataFrame:
    return D.allocate(V.questions(table(spark, d, "questions")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "n", 250)


_BUD = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {h})" for k, (a, b, c, h) in D.BUDGETS.items()) + ") v(k, pk, fk, tk, hi)"


@q("dd_document_budget", with_("fa", f"""SELECT doc_id, n_facts, n_pages, doc_type, signal, greatest(24, least(round_even(pk * signal, 0)::INT, hi)) AS pairs, greatest(8, least(round_even(fk * signal, 0)::INT, 128)) AS fallback, greatest(4, least(round_even(tk * signal, 0)::INT, 64)) AS target
  FROM (SELECT *, round(log2(n_facts + 1.0::DOUBLE) * log2(n_pages + 1.0::DOUBLE), 6) AS signal FROM (SELECT doc_id, count(*) AS n_facts, greatest(1, count(DISTINCT page_start)) AS n_pages FROM fa GROUP BY 1) JOIN (SELECT doc_id, doc_type FROM documents) USING (doc_id)) JOIN {_BUD} ON k = CASE WHEN doc_type IN ('ISO_STANDARD', 'TEXTBOOK', 'REPORT') THEN doc_type ELSE 'UNKNOWN' END"""))
def dd_document_budget(spark: SparkSession, d: str) -> DataFrame:
    f = V.facts(table(spark, d, "chunks")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"), F.greatest(F.lit(1), F.count_distinct("page_start")).alias("n_pages"))
    return D.document_budget(f.join(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_id"))


@q("dd_category_caps", with_("qu", "SELECT q_id, hop_type, accepted FROM (SELECT q_id, hop_type, row_number() OVER (PARTITION BY doc_id, hop_type ORDER BY q_id) AS attempt FROM qu) t, (VALUES (true)) v(accepted) WHERE attempt <= 2"))
def dd_category_caps(spark: SparkSession, d: str) -> DataFrame:
    """At most two attempts per document and kind, in order: a cap that is the feature."""
    u = V.questions(table(spark, d, "questions")).withColumn("attempt", F.row_number().over(Window.partitionBy("doc_id", "hop_type").orderBy("q_id")))
    return u.filter("attempt <= 2").select("q_id", "hop_type", F.lit(True).alias("accepted"))


@q("dd_kind_deficit", with_("qu", "SELECT hop_type, round(0.25::DOUBLE - count(*)::DOUBLE / (SELECT count(*) FROM qu), 6) AS deficit FROM qu GROUP BY 1"))
def dd_kind_deficit(spark: SparkSession, d: str) -> DataFrame:
    """How far each kind falls short of its share."""
    c = V.questions(table(spark, d, "questions")).groupBy("hop_type").agg(F.count(F.lit(1)).alias("c"))
    return c.select("hop_type", F.round(0.25 - F.col("c") / c.agg(F.sum("c")).scalar(), 6).alias("deficit"))


@q("dd_depth_targets", "SELECT depth, greatest(1, round_even(200 * frac * 1.5::DOUBLE, 0)::INT) AS n FROM (VALUES (1, 0.5::DOUBLE), (2, 0.35::DOUBLE), (3, 0.15::DOUBLE), (4, 0.0::DOUBLE)) v(depth, frac)")
def dd_depth_targets(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1, 0.5), (2, 0.35), (3, 0.15), (4, 0.0)], "depth int, frac double")
    return t.select("depth", F.greatest(F.lit(1), F.bround(200 * F.col("frac") * 1.5, 0).cast("int")).alias("n"))


@q("dd_hash_sample", with_("qu", "SELECT q_id FROM qu WHERE ('0x' || sha256(q_id)[1:15])::BIGINT::DOUBLE / 1152921504606846975.0::DOUBLE <= 0.3::DOUBLE"))
def dd_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(table(spark, d, "questions")).filter(D.hash_share(F.col("q_id")) <= 0.3).select("q_id")


@q("dd_document_seed", "SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS seed FROM documents")
def dd_document_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long").alias("seed"))


@q("dd_abstention_twins", with_("go ch qu", f"SELECT q_id, min_by(chunk_id, (s, chunk_id)) AS removed, count(*) - 1 AS n_left FROM (SELECT go.q_id, go.chunk_id, round(len(list_intersect(list_distinct({tok('qu.answer')}), list_distinct({tok('ch.text')})))::DOUBLE / greatest(1, len(list_distinct({tok('qu.answer')}))), 6) AS s FROM go JOIN ch USING (chunk_id) JOIN qu ON qu.q_id = go.q_id WHERE qu.answer IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2"))
def dd_abstention_twins(spark: SparkSession, d: str) -> DataFrame:
    """Questions made unanswerable by taking away the evidence that supports their answer least."""
    t = table(spark, d, "questions")
    r = V.gold(t).join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id").join(V.questions(t).filter("answer is not null").select("q_id", "answer"), "q_id")
    s = F.round(Y.support(F.col("text"), F.col("answer")), 6)
    return r.groupBy("q_id").agg(F.min_by("chunk_id", F.struct(s.alias("s"), F.col("chunk_id").alias("c"))).alias("removed"), (F.count(F.lit(1)) - 1).alias("n_left")).filter("n_left >= 1")


_CL = f"""cl AS (SELECT q_id, i, c, {tok('c')} AS ct FROM (SELECT q_id, unnest(l) AS c, unnest(range(len(l)))::INT AS i FROM (SELECT q_id, regexp_extract_all(answer, '[^.!?]+(?:[.!?]+|$)') AS l FROM qu))),
gs AS (SELECT cl.q_id, cl.i, go.chunk_id, CASE WHEN len(ct) > 0 THEN round(len(list_intersect(list_distinct(ct), list_distinct({tok('ch.text')})))::DOUBLE / len(list_distinct(ct)), 6) ELSE 0.0 END AS s FROM cl JOIN go USING (q_id) JOIN ch USING (chunk_id))"""


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """q_id, i, chunk_id, s: support of each clause of the gold answer by each evidence chunk."""
    t = table(spark, d, "questions")
    c = V.questions(t).select("q_id", F.posexplode(T.extract_all(F.col("answer"), "[^.!?]+(?:[.!?]+|$)")).alias("i", "c"))
    r = c.join(V.gold(t), "q_id").join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id")
    return r.select("q_id", "i", "chunk_id", F.round(Y.support(F.col("text"), F.col("c")), 6).alias("s"))


_GOCH = with_("go ch", "").rstrip()


@q("nl_clause_grounding", f"{_GOCH},\n{_CL}\nSELECT q_id, i, max_by(chunk_id, (s, chunk_id)) AS chunk_id, max(s) AS support, max(s) >= 0.5::DOUBLE AS grounded FROM gs GROUP BY 1, 2")
def nl_clause_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _clauses(spark, d).groupBy("q_id", "i").agg(F.max_by("chunk_id", F.struct("s", "chunk_id")).alias("chunk_id"), F.max("s").alias("support"), (F.max("s") >= 0.5).alias("grounded"))


_GATE = "CASE WHEN n_clauses = 0 THEN 'no_clause' WHEN clause_min < 0.3::DOUBLE THEN 'clause_min' WHEN single_max >= 0.99::DOUBLE AND n_chunks > 1 THEN 'single_max' ELSE 'passed' END"


@q("nl_group_gate", f"{_GOCH},\n{_CL}, cm AS (SELECT q_id, i, max(s) AS best FROM gs GROUP BY 1, 2), cc AS (SELECT q_id, chunk_id, avg(s) AS m FROM gs GROUP BY 1, 2), gg AS (SELECT q_id, count(*) AS n_clauses, min(best) AS clause_min FROM cm GROUP BY 1), hh AS (SELECT q_id, count(*) AS n_chunks, max(m) AS single_max FROM cc GROUP BY 1)\nSELECT {_GATE} AS verdict, count(*) AS n FROM gg JOIN hh USING (q_id) GROUP BY 1")
def nl_group_gate(spark: SparkSession, d: str) -> DataFrame:
    """The cascade of gates on a pair's clause scores, with counts by the first that fails."""
    c = _clauses(spark, d)
    a = c.groupBy("q_id", "i").agg(F.max("s").alias("best")).groupBy("q_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.min("best").alias("clause_min"))
    b = c.groupBy("q_id", "chunk_id").agg(F.avg("s").alias("m")).groupBy("q_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("m").alias("single_max"))
    v = F.when(F.col("n_clauses") == 0, "no_clause").when(F.col("clause_min") < 0.3, "clause_min").when((F.col("single_max") >= 0.99) & (F.col("n_chunks") > 1), "single_max").otherwise("passed")
    return a.join(b, "q_id").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@q("nl_leave_one_out", f"""{_GOCH}, gt AS (SELECT q_id, list(text ORDER BY chunk_id) AS items, list(chunk_id ORDER BY chunk_id) AS ids FROM go JOIN ch USING (chunk_id) GROUP BY 1), lo AS (SELECT gt.q_id, j, array_to_string(list_filter(items, lambda x, i: i <> j + 1), ' ') AS premise, qu.answer FROM gt JOIN qu USING (q_id), LATERAL (SELECT unnest(range(len(items))) AS j) WHERE len(items) >= 2 AND qu.answer IS NOT NULL),
sc AS (SELECT q_id, j, CASE WHEN len({tok('answer')}) > 0 THEN len(list_intersect(list_distinct({tok('answer')}), list_distinct({tok('premise')})))::DOUBLE / len(list_distinct({tok('answer')})) ELSE 0.0 END AS s FROM lo)
SELECT q_id, count(*) AS n, count_if(s < 0.5::DOUBLE) AS n_necessary, round(count_if(s < 0.5::DOUBLE)::DOUBLE / count(*), 3) AS necessity FROM sc GROUP BY 1""")
def nl_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "questions")
    g = V.gold(t).join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id").groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("x")).select("q_id", F.transform("x", lambda x: x["text"]).alias("items"))
    rows = Y.leave_one_out(g.join(V.questions(t).filter("answer is not null").select("q_id", "answer"), "q_id"))
    return Y.necessity(rows.withColumn("score", Y.support(F.col("premise"), F.col("answer"))), "q_id")


@q("nl_distinct_pairs", with_("rk qu ch", "SELECT count(*) AS n, count(DISTINCT (text, answer)) AS n_distinct FROM rk JOIN qu USING (q_id) JOIN ch USING (chunk_id) WHERE answer IS NOT NULL"))
def nl_distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs a model would be asked about, and how many of them differ."""
    t = table(spark, d, "questions")
    p = V.ranked(table(spark, d, "retrievals")).join(V.questions(t).filter("answer is not null").select("q_id", "answer"), "q_id").join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id")
    per = p.groupBy(F.sha2(F.concat_ws("\u0001", "text", "answer"), 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@q("nl_pair_scores")
def nl_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of distinct pairs by a Python function in batches, as a model would give them."""

    def score(pairs):
        import re

        out = []
        for a, b in pairs:
            x, y = set(re.findall("[a-z0-9]+", a.lower())), set(re.findall("[a-z0-9]+", b.lower()))
            out.append(len(x & y) / len(y) if y else 0.0)
        return out

    t = table(spark, d, "questions")
    p = V.gold(t).join(V.questions(t).select("q_id", "answer"), "q_id").join(V.chunk_rows(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id")
    return Y.scored(p.select(F.col("text").alias("premise"), F.col("answer").alias("hypothesis")), score)


@q("nl_verify_pairs", f"""{_GOCH},\n{_CL}, b AS (SELECT q_id, min(m) AS faithful FROM (SELECT q_id, i, max(s) AS m FROM gs GROUP BY 1, 2) GROUP BY 1), w AS (SELECT q_id, doc_id, list_distinct({tok('question')}) AS t FROM qu WHERE question IS NOT NULL),
  du AS (SELECT DISTINCT b.q_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.q_id < b.q_id WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.6::DOUBLE)
  SELECT CASE WHEN q_id IN (SELECT q_id FROM du) THEN 'duplicate' WHEN abs(faithful - 0.5::DOUBLE) <= 0.05::DOUBLE THEN 'borderline' WHEN faithful < 0.5::DOUBLE THEN 'unfaithful' ELSE 'verified' END AS verdict, count(*) AS n FROM b GROUP BY 1""")
def nl_verify_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on pairs: a question much like an earlier one of its document, unfaithful to its evidence, close to the line, or verified."""
    b = _clauses(spark, d).groupBy("q_id", "i").agg(F.max("s").alias("m")).groupBy("q_id").agg(F.min("m").alias("faithful"))
    w = V.questions(table(spark, d, "questions")).filter("question is not null").select("q_id", "doc_id", F.array_distinct(T.tokens(F.col("question"))).alias("t"))
    o = w.select(F.col("q_id").alias("o"), "doc_id", F.col("t").alias("u"))
    dup = w.join(o, "doc_id").filter("o < q_id").filter(T.jaccard(F.col("t"), F.col("u")) >= 0.6).select("q_id", F.lit(True).alias("dup")).distinct()
    v = F.when(F.col("dup"), "duplicate").when(F.abs(F.col("faithful") - 0.5) <= 0.05, "borderline").when(F.col("faithful") < 0.5, "unfaithful").otherwise("verified")
    return b.join(dup, "q_id", "left").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
