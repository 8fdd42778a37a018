"""Fact graph: bridges between pages, scored pairs, paths and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.predicates import role
from quarry.functions.text import STOPWORDS, bridge_tokens, content_tokens, jaccard

# Bonus of a pair of roles, and cues of conditions, outcomes and setups.
ROLE_BONUS = {("definition", "rule"): 0.08, ("condition", "consequence"): 0.10, ("rule", "exception"): 0.09, ("definition", "condition"): 0.06, ("rule", "constraint"): 0.06}
CONDITION_CUE = r"(?i)\b(if|when|where|once|unless|before|after|during)\b"
OUTCOME_CUE = r"(?i)\b(must|shall|requires?|limits?|records|carries)\b"
MAX_PAGES = 4


def phrases(facts: DataFrame, sizes: tuple[int, ...] = (4, 3, 2)) -> DataFrame:
    """doc_id, fact_id, page, norm: salient phrases of two to four folded tokens; no stopword at either end, one word of four letters at least."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    t = facts.select("doc_id", "fact_id", F.col("page_start").alias("page"), bridge_tokens(F.col("text")).alias("t"))
    grams = [_slices(n) for n in sizes]
    empty = F.expr("cast(array() as array<array<string>>)")
    rows = t.select("doc_id", "fact_id", "page", F.explode(F.concat(*(F.coalesce(g, empty) for g in grams))).alias("g"))
    ok = ~F.array_contains(stop, F.element_at("g", 1)) & ~F.array_contains(stop, F.element_at("g", -1)) & F.exists("g", lambda x: x.rlike("^[a-z]{4,}$"))
    return rows.filter(ok).select("doc_id", "fact_id", "page", F.array_join("g", " ").alias("norm")).distinct()


def _slices(n: int) -> Column:
    return F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n)))


def bridge_groups(facts: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """doc_id, norm, fact_ids: phrases of two facts at least on two to `max_pages` pages; of equal sets of facts the longest phrase stays.

    A phrase's facts are gathered by page, and of the pages only as many as tell that there are too many.
    """
    page = phrases(facts).groupBy("doc_id", "norm", "page").agg(F.collect_set("fact_id").alias("ids"))
    some = F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy(F.asc_nulls_first("page")))
    few = page.withColumn("r", some).filter(F.col("r") <= max_pages + 2)  # enough to see that there are too many
    g = few.groupBy("doc_id", "norm").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("fact_ids"), F.count("page").alias("n_pages")).filter((F.size("fact_ids") >= 2) & F.col("n_pages").between(2, max_pages))
    return g.groupBy("doc_id", "fact_ids").agg(F.max_by("norm", F.struct(F.length("norm"), "norm")).alias("norm"))


def bridge_pairs(facts: DataFrame, alike: float = 0.6) -> DataFrame:
    """fact_a, fact_b, norm, overlap: facts of one group on different pages that are no restatement; the longest phrase of each pair.

    A group spans few pages of one document, so its pairs are as bounded as a page's text.
    """
    f = facts.select("fact_id", F.col("page_start").alias("page"), content_tokens(F.col("text")).alias("c"))
    g = bridge_groups(facts).select("norm", F.explode("fact_ids").alias("fact_id"), "fact_ids")
    a = g.join(f, "fact_id").select("norm", F.col("fact_id").alias("fact_a"), F.col("page").alias("pa"), F.col("c").alias("ca"), F.explode("fact_ids").alias("fact_b")).filter("fact_a < fact_b")
    b = f.select(F.col("fact_id").alias("fact_b"), F.col("page").alias("pb"), F.col("c").alias("cb"))
    own = lambda c: F.filter(c, lambda x: ~F.array_contains(F.split("norm", " "), x))
    pairs = a.join(b, "fact_b").filter("pa <> pb").withColumn("overlap", F.round(jaccard(own(F.col("ca")), own(F.col("cb"))), 6)).filter(F.col("overlap") < alike)
    best = F.max_by(F.struct("norm", "overlap"), F.struct(F.length("norm"), "norm"))
    return pairs.groupBy("fact_a", "fact_b").agg(best.alias("x")).select("fact_a", "fact_b", "x.norm", "x.overlap")


def role_bonus(a: Column, b: Column) -> Column:
    out = F.when(a != b, 0.03).otherwise(0.0)
    for (x, y), v in ROLE_BONUS.items():
        out = F.when((a == x) & (b == y), v).otherwise(out)
    return out


def neighbour_pairs(facts: DataFrame, window: int = 3) -> DataFrame:
    """fact_a, fact_b, distance, score: facts up to `window` places apart, scored by shared content, roles and direction."""
    w = Window.partitionBy("doc_id").orderBy("order_idx")
    f = facts.select("doc_id", "order_idx", F.struct("fact_id", F.col("page_start").alias("page"), "text", content_tokens(F.col("text")).alias("c"), role(F.col("text")).alias("role")).alias("f"))
    f = f.withColumn("after", F.array(*(F.lead("f", k).over(w) for k in range(1, window + 1))))
    p = f.select("doc_id", F.col("f").alias("a"), F.posexplode("after").alias("k", "b")).filter("b is not null")
    shared = F.size(F.array_intersect("a.c", "b.c")) / F.greatest(F.lit(1), F.least(F.size("a.c"), F.size("b.c")))
    directed = F.when(F.col("a.text").rlike(CONDITION_CUE) & F.col("b.text").rlike(OUTCOME_CUE), 0.10).otherwise(0.0)
    score = F.round(F.least(F.lit(0.08), shared * 0.08) + role_bonus(F.col("a.role"), F.col("b.role")) + directed, 6)
    return p.select("doc_id", F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), (F.col("k") + 1).alias("distance"), F.col("a.page").alias("page_a"), F.col("b.page").alias("page_b"), F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b"), F.round(shared, 6).alias("shared"), score.alias("score"))


def schedule(pairs: DataFrame, per_anchor: int = 2, per_page_pair: int = 24) -> DataFrame:
    """The best pairs of each anchor, then of each pair of pages; ties by id."""
    anchor = Window.partitionBy("fact_a").orderBy(F.desc("score"), "fact_b")
    pages = Window.partitionBy("doc_id", "page_a", "page_b").orderBy(F.desc("score"), "fact_a", "fact_b")
    return pairs.withColumn("r", F.row_number().over(anchor)).filter(F.col("r") <= per_anchor).withColumn("r", F.row_number().over(pages)).filter(F.col("r") <= per_page_pair).drop("r")


def prefilter_reason(p: DataFrame) -> Column:
    """Why a scored pair is dropped before anything costly looks at it, or null."""
    gap = F.coalesce(F.abs(F.col("page_a") - F.col("page_b")), F.lit(0))
    weak = F.col("shared") < 0.1
    return F.when(F.col("shared") >= 0.8, "near_duplicate_fact_text").when((gap > 5) & weak, "page_gap_outlier_combined").when(weak & (F.col("score") < 0.05), "weak_bridge")


def paths(edges: DataFrame, depth: int = 3, per_start: int = 2) -> DataFrame:
    """path, weight: simple paths of `depth` facts along the edges (fact_a, fact_b, score), the best of each start.

    Each hop keeps the best `per_start` extensions of a start before the next, so nothing grows with the square.
    """
    p = edges.select(F.array("fact_a", "fact_b").alias("path"), F.col("score").alias("weight"))
    e = edges.select(F.col("fact_a").alias("at"), "fact_b", "score")
    w = Window.partitionBy(F.element_at("path", 1)).orderBy(F.desc("weight"), F.array_join("path", "|"))
    for _ in range(depth - 2):
        p = p.withColumn("at", F.element_at("path", -1)).join(e, "at").filter(~F.array_contains("path", F.col("fact_b")))
        p = p.select(F.concat("path", F.array("fact_b")).alias("path"), F.round(F.col("weight") * F.col("score"), 6).alias("weight"))
        p = p.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_start).drop("r")
    return p


def greedy_chains(pairs: DataFrame, depth: int = 4) -> DataFrame:
    """start, path: from every fact that has a next one, the chain of best next facts, up to `depth` facts.

    pairs: fact_a, fact_b (later in the document), score, distance. Of equal scores the nearer is taken. Every fact has one
    best next fact, so each hop is one equi-join and a chain never branches or turns back.
    """
    best = pairs.groupBy("fact_a").agg(F.max_by("fact_b", F.struct("score", -F.col("distance"))).alias("fact_b"))
    chains = best.select(F.col("fact_a").alias("start"), F.array("fact_a", "fact_b").alias("path"), F.col("fact_b").alias("fact_a"))
    for _ in range(depth - 2):
        longer = chains.join(best, "fact_a", "left")
        chains = longer.select("start", F.when(F.col("fact_b").isNull(), F.col("path")).otherwise(F.concat("path", F.array("fact_b"))).alias("path"), F.col("fact_b").alias("fact_a"))
    return chains.select("start", "path")


def nearest_in_band(pairs: DataFrame, least: float = 0.1, most: float = 0.8) -> DataFrame:
    """fact, near: the facts of a fact's page around it, nearest first, the earlier on ties, that share enough but not too much.

    pairs: neighbour_pairs, so a fact has at most twice their window of such neighbours.
    """
    kept = pairs.filter((F.col("page_a") == F.col("page_b")) & (F.col("shared") >= least) & (F.col("shared") < most))
    both = kept.select(F.col("fact_a").alias("fact"), F.col("fact_b").alias("other"), "distance", F.lit(1).alias("later")).unionByName(kept.select(F.col("fact_b").alias("fact"), F.col("fact_a").alias("other"), "distance", F.lit(0).alias("later")))
    return both.groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("distance", "later", "other"))).alias("n")).select("fact", F.transform("n", lambda x: x["other"]).alias("near"))


def clusters(bridges: DataFrame, near: DataFrame) -> DataFrame:
    """fact_a, fact_a2, fact_b, fact_b2, kind: bridge pairs with the nearest fact in band of either side.

    The second lookup leaves out what the first has taken. A pair that lacks a neighbour on a side stays a `pair` of two
    facts; others are a `cluster_2plus2`.
    """
    rows = bridges.select("fact_a", "fact_b").join(near.toDF("fact_a", "na"), "fact_a", "left").join(near.toDF("fact_b", "nb"), "fact_b", "left")
    rows = rows.withColumn("a2", F.try_element_at(F.filter("na", lambda x: (x != F.col("fact_a")) & (x != F.col("fact_b"))), F.lit(1)))
    rows = rows.withColumn("b2", F.try_element_at(F.filter("nb", lambda x: (x != F.col("fact_a")) & (x != F.col("fact_b")) & (x != F.coalesce("a2", F.lit("")))), F.lit(1)))
    whole = F.col("a2").isNotNull() & F.col("b2").isNotNull()
    return rows.select("fact_a", F.when(whole, F.col("a2")).alias("fact_a2"), "fact_b", F.when(whole, F.col("b2")).alias("fact_b2"), F.when(whole, "cluster_2plus2").otherwise("pair").alias("kind"))


# Which roles are taken first for single facts; examples are never taken.
ROLE_RANK = {"definition": 0, "rule": 1, "condition": 2, "constraint": 3, "consequence": 4, "exception": 5}


def single_chains(facts: DataFrame, score: Column, limit: int = 12, words: tuple[int, int] = (6, 60)) -> DataFrame:
    """doc_id, fact_id, place: at most `limit` facts of each document, for questions of one hop.

    First the best fact of each page, then the next best of all; by score, page, role and length. facts: doc_id, fact_id,
    text, page_start.
    """
    text, kind = F.col("text"), role(F.col("text"))
    rank = F.lit(6)
    for name, place in ROLE_RANK.items():
        rank = F.when(kind == name, place).otherwise(rank)
    n = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    use = facts.filter(n.between(*words) & (kind != "example")).select("doc_id", "fact_id", (-score).alias("s"), F.coalesce("page_start", F.lit(0)).alias("page"), rank.alias("role"), F.length(text).alias("l"))
    order = ["s", "page", "role", "l", "fact_id"]
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)) > 1
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("again", *order))
    return use.withColumn("again", first).withColumn("place", place).filter(F.col("place") <= limit).select("doc_id", "fact_id", "place")
