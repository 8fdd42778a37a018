"""Evidence metrics of ranked lists. Two definitions of the same name stay two functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import share_held, tokens
from quarry.operators.overlap import overlaps, possible, sketches

KS = (1, 3, 5, 10)
#: Share of a unit's tokens that one chunk must hold.
HELD = 0.6


def relevance(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per retrieval of a question with evidence: ret_id, q_id, mode, n, n_gold, rel (ranks of evidence chunks, ascending).

    The ranks of one list are gathered, as many as it is long.
    """
    need = gold.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = ranked.join(gold.withColumn("rel", F.lit(True)), ["q_id", "chunk_id"], "left")
    per = hit.groupBy("ret_id", "q_id", "mode").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rel"), F.col("rank")))).alias("rel"))
    return per.join(need, "q_id")


def within(rel: Column, k: int) -> Column:
    return F.filter(rel, lambda r: r <= k)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def recall_at(rel: Column, n_gold: Column, k: int) -> Column:
    return ratio(F.size(within(rel, k)), n_gold)


def precision_at(rel: Column, k: int) -> Column:
    """Over k places, whether filled or not."""
    return F.size(within(rel, k)) / F.lit(float(k))


def precision_of_list(rel: Column, n: Column) -> Column:
    """Over what was retrieved."""
    return ratio(F.size(rel), n)


def rank_weighted(rel: Column) -> Column:
    """Mean over the relevant ranks of the precision there; 0 without any."""
    parts = F.transform(rel, lambda r, i: (i + 1) / r)
    return F.when(F.size(rel) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(rel)).otherwise(0.0)


def first_rank(rel: Column) -> Column:
    """Reciprocal of the first relevant rank."""
    return F.when(F.size(rel) > 0, 1 / F.array_min(rel)).otherwise(0.0)


def mean_reciprocal(rel: Column) -> Column:
    """Mean of the reciprocals of all relevant ranks."""
    return F.when(F.size(rel) > 0, F.aggregate(F.transform(rel, lambda r: 1 / r), F.lit(0.0), lambda s, x: s + x) / F.size(rel)).otherwise(0.0)


def ndcg_at(rel: Column, k: int) -> Column:
    """Binary; the ideal list has the retrieved hits in front."""
    r = within(rel, k)
    gain = F.aggregate(F.transform(r, lambda x: 1 / F.log2(x + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(r, lambda x, i: 1 / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(r) > 0, gain / ideal).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def at_all(rel_rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per retrieval and k: recall, precision, precision_rw, hit (all evidence), ndcg, mrr."""
    rows = rel_rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    r = F.filter("rel", lambda x: x <= F.col("k"))
    gain = F.aggregate(F.transform(r, lambda x: 1 / F.log2(x + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(r, lambda x, i: 1 / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "ret_id", "q_id", "mode", "k", ratio(F.size(r), F.col("n_gold")).alias("recall"), (F.size(r) / F.col("k")).alias("precision"), rank_weighted(r).alias("precision_rw"),
        (F.size(r) == F.col("n_gold")).cast("int").alias("hit"), F.when(F.size(r) > 0, gain / ideal).otherwise(0.0).alias("ndcg"), first_rank(F.col("rel")).alias("mrr"),
    )


def sweep(at: DataFrame) -> DataFrame:
    """mode, k, n, recall, precision, precision_rw, f1, f1_rw, hit_rate: F1 of the means, not the mean of F1s.

    Means are rounded to 9 places first: the order in which a sum is taken must not decide a tie at the fourth.
    """
    m = at.groupBy("mode", "k").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in ("recall", "precision", "precision_rw")), F.round(F.avg("hit"), 9).alias("hit_rate"))
    return m.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "f1_rw": f1(F.col("precision_rw"), F.col("recall"))}).select("mode", "k", "n", *(F.round(c, 4).alias(c) for c in ("recall", "precision", "precision_rw", "f1", "f1_rw", "hit_rate")))


def unit_hits(units: DataFrame, lists: DataFrame) -> DataFrame:
    """ret_id, unit_id, held, hit: the best share of each unit's tokens (repeats counted) in one chunk of each list.

    units: q_id, unit_id, unit; lists: ret_id, q_id, rank, ct (a chunk's distinct tokens).
    """
    u = units.select("q_id", "unit_id", tokens(F.col("unit")).alias("ut"))
    met = lists.select("ret_id", "q_id", "rank", "ct").join(u, "q_id").withColumn("share", share_held(F.col("ut"), F.col("ct")))
    return met.groupBy("ret_id", "q_id", "unit_id").agg(F.max("share").alias("held"), F.min(F.when(F.col("share") >= HELD, F.col("rank"))).alias("rank")).withColumn("hit", F.col("rank").isNotNull())


#: Shares from which a required text counts as present in words, and as present by its vector.
IN_WORDS, BY_VECTOR = 0.8, 0.75


def layers(ranked: DataFrame, required: DataFrame, texts: DataFrame) -> DataFrame:
    """ret_id, q_id, chunk_id, retrieved, in_words, by_vector: each required chunk of a retrieval on three layers.

    It is retrieved if its id is in the list; present in words if one retrieved chunk holds IN_WORDS of its distinct tokens;
    present by vector if the cosine with one retrieved chunk, of counts of tokens, reaches BY_VECTOR. ranked: ret_id, q_id,
    chunk_id; required: q_id, chunk_id; texts: chunk_id, text. A list without chunks or with unknown ones has nothing present.

    Each pair of chunks is met once for each question, however many lists hold it. Sketches, a byte a token, are shuffled to the
    questions; texts follow only for the pairs whose sketches leave it open that they reach a threshold. Gathered are the chunks of one
    list, the evidence of one question, and the other chunks its lists hold that reach a threshold.
    """
    lists = ranked.groupBy("ret_id", "q_id").agg(F.collect_set("chunk_id").alias("ids"))
    sketched = sketches(texts)
    wanted = required.join(sketched, "chunk_id", "left")
    worded = F.col("sketch").isNotNull() & F.col("n").isNotNull() & F.col("squares").isNotNull()  # all columns, so that one shuffle of sketches serves all joins
    asked = lists.join(wanted.groupBy("q_id").agg(F.collect_list(F.struct("chunk_id", worded.alias("worded"))).alias("wanted")), "q_id")
    others = lists.join(required.select("q_id").distinct(), "q_id", "left_semi").select("q_id", F.explode("ids").alias("other")).distinct()
    met = others.join(sketched, others["other"] == sketched["chunk_id"]).select("q_id", "other", F.col("sketch").alias("osketch"), F.col("n").alias("on"), F.col("squares").alias("osquares"))
    met = met.join(required.join(sketched, "chunk_id"), "q_id").filter("chunk_id <> other")
    close = possible(met, IN_WORDS, BY_VECTOR)
    scored = overlaps(close.join(texts.select("chunk_id", "text"), "chunk_id").join(texts.select(F.col("chunk_id").alias("other"), F.col("text").alias("otext")), "other"), "text", "otext")
    held, cosine = F.round(ratio(F.col("shared"), F.col("n")), 6), F.round(ratio(F.col("dot"), F.sqrt("squares") * F.sqrt("osquares")), 6)
    found = scored.select("q_id", "chunk_id", "other", (held >= IN_WORDS).alias("in_words"), (cosine >= BY_VECTOR).alias("by_vector")).filter("in_words or by_vector")
    by = found.groupBy("q_id", "chunk_id").agg(*(F.collect_set(F.when(F.col(c), F.col("other"))).alias(c) for c in ("in_words", "by_vector")))
    rows = asked.join(by.groupBy("q_id").agg(F.collect_list(F.struct("chunk_id", "in_words", "by_vector")).alias("found")), "q_id", "left").select("ret_id", "q_id", "ids", "found", F.explode("wanted").alias("w"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    near = lambda layer: F.exists("found", lambda f: (f.chunk_id == F.col("w.chunk_id")) & F.arrays_overlap(f[layer], F.col("ids")))
    retrieved = F.array_contains("ids", F.col("w.chunk_id"))
    itself = retrieved & flag(F.col("w.worded"))
    return rows.select("ret_id", "q_id", "w.chunk_id", retrieved.alias("retrieved"), (itself | flag(near("in_words"))).alias("in_words"), (itself | flag(near("by_vector"))).alias("by_vector"))


def layered(rows: DataFrame) -> DataFrame:
    """Recall of each retrieval by layer: by id, by words, by vector, by id and each of these, and by any."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    a, b, c = F.col("retrieved"), F.col("in_words"), F.col("by_vector")
    return rows.groupBy("ret_id", "q_id").agg(F.count(F.lit(1)).alias("n"), share(a).alias("recall"), share(b).alias("text_recall"), share(a & b).alias("strict_recall"), share(c).alias("text_recall_l3"), share(a & c).alias("strict_recall_l13"), share(a | b | c).alias("text_recall_any"))


def group_recall(ranked: DataFrame, required: DataFrame) -> DataFrame:
    """ret_id, n_groups, group_recall, joint: required is q_id, chunk_id, grp; a group is met if all its chunks are retrieved."""
    lists = ranked.select("ret_id", "q_id", "chunk_id").distinct()
    rows = lists.select("ret_id", "q_id").distinct().join(required, "q_id").join(lists.select("ret_id", "chunk_id", F.lit(1).alias("hit")), ["ret_id", "chunk_id"], "left")
    groups = rows.groupBy("ret_id", "grp").agg(F.min(F.coalesce("hit", F.lit(0))).alias("met"))
    return groups.groupBy("ret_id").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("met"), 6).alias("group_recall"), (F.min("met") == 1).alias("joint"))
