"""Indexes, scores, fusion and reranking of ranked lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens

K1, B, RRF_K = 1.5, 0.75, 60
#: Queries whose tokens are broadcast, at most.
QUERIES = 2000
#: Units that a task scores against all queries at once.
UNITS = 512
#: Query vectors that a task holds at once; more of them are searched block by block.
QUERY_BLOCK = 4096
#: Vectors of a block that meets every other block in one task.
LINK_BLOCK = 4096


def postings(units: DataFrame, unit: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """unit, kept columns, token, tf. Units without a token have no posting; repeated units must be gone before."""
    return units.select(unit, *keep, F.explode(tokens(F.col(text))).alias("token")).groupBy(unit, *keep, "token").agg(F.count(F.lit(1)).alias("tf"))


def lengths(units: DataFrame, unit: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return units.select(unit, *keep, F.size(tokens(F.col(text))).alias("dl"))


def bm25(queries: DataFrame, units: DataFrame, within: tuple[str, ...] = (), query: tuple[str, ...] = ("q_id",), unit: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """query columns, unit, score (6 decimals) of every unit that shares a token with the query.

    queries: query columns, `within`, text; units: unit, `within`, text. With `within`, numbers of units, frequencies and
    mean lengths are those of each group, and a query meets its own group's units only. Distinct query tokens count.
    Everything is an equi-join on the token; the query side is what the caller states and is never multiplied by all units.
    Up to QUERIES queries their weighted tokens are broadcast, and units that come partitioned by `unit` (or that are put so
    once) are scored without another shuffle; more queries are joined by shuffling the postings on the token.
    """
    keys = list(within)
    few = not keys and queries.limit(QUERIES + 1).count() <= QUERIES
    post = postings(units.withColumn("dl", F.size(tokens(F.col("text")))), unit, keep=(*within, "dl"))  # lengths travel with the postings
    stats = lengths(units, unit, keep=within).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))
    asked = queries.select(*query, *keys, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    met = post.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi") if few else post
    df = met.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    one = df.join(stats, keys) if keys else df.withColumns({"n": stats.select("n").scalar(), "avgdl": stats.select("avgdl").scalar()})
    idf = one.select(*keys, "token", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    weighted = asked.join(idf, [*keys, "token"])
    met = met.join(F.broadcast(weighted) if few else weighted, [*keys, "token"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy(*query, unit).agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int, query: tuple[str, ...] = ("q_id",), unit: str = "chunk_id") -> DataFrame:
    """The k best units of each query with their rank; ties go to the smaller unit. Each task keeps its k best before the shuffle."""
    w = Window.partitionBy(*query).orderBy(F.desc("score"), F.asc(unit))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Best:
    """The k best units of each query seen so far, and the score that a unit needs to become one of them."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.need, self.held = k, np.zeros(queries), []

    def add(self, q: np.ndarray, score: np.ndarray, units: np.ndarray) -> None:
        self.held.append((q, score, units))
        if sum(len(x[0]) for x in self.held) > 4 * self.k * len(self.need) + 10_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the best; ties go to the smaller unit."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        q, score, units = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        by_unit = np.argsort(units, kind="stable")
        order = by_unit[np.lexsort((-score[by_unit], q[by_unit]))]
        q, score, units = q[order], score[order], units[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        full = q[place == self.k - 1]
        self.need[full] = score[place == self.k - 1]
        self.held = [(q[keep], score[keep], units[keep])]
        return self.held[0]


_TOKEN = re.compile("[a-z0-9]+")


def bm25_top(queries: DataFrame, units: DataFrame, k: int, query: tuple[str, ...] = ("q_id",), unit: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """The k best units of each query by `bm25`, with score and rank: the same rows as top_k(bm25(...), k).

    Up to QUERIES queries, the case of a stated query set, are sent to every task as a matrix of their weighted tokens; a
    task scores a batch of units against all of them by one product, drops what can't be among a query's best any more, and
    gives k rows a query. So nothing is exploded to pairs of query and unit, and texts don't leave their place. More queries
    take the way of `bm25`.
    """
    asked = queries.select(*query, "text").filter("text is not null").limit(QUERIES + 1).collect()
    if len(asked) > QUERIES:
        return top_k(bm25(queries, units, query=query, unit=unit, k1=k1, b=b), k, query, unit)
    words = [set(_TOKEN.findall(r[-1].lower())) for r in asked]
    terms = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    spark = units.sparkSession
    known = F.broadcast(spark.createDataFrame([(w,) for w in terms], "token string"))
    df = dict(units.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(known, "token", "left_semi").groupBy("token").count().collect()) if terms else {}
    total = units.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("dl")).first()
    n, mean = total.n, (total.dl or 0) / max(1, total.n)
    weight = np.zeros((len(terms), len(asked)))
    for j, w in enumerate(words):
        for x in w:
            weight[terms[x], j] = np.log((n - df.get(x, 0) + 0.5) / (df.get(x, 0) + 0.5) + 1)
    held = spark.sparkContext.broadcast((terms, weight, [tuple(r[:-1]) for r in asked]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, weight, keys = held.value
        best, of = _Best(len(keys), k), terms.get
        for p in batches:
            for at in range(0, len(p), UNITS):
                part = p.iloc[at : at + UNITS]
                found = [_TOKEN.findall(t.lower()) if isinstance(t, str) else [] for t in part.iloc[:, 1]]
                ids = [[i for w in t if (i := of(w)) is not None] for t in found]
                tf = np.zeros((len(part), len(terms)))
                np.add.at(tf, (np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([i for x in ids for i in x], dtype=np.int64)), 1)
                long = np.array([len(t) for t in found], dtype=float)[:, None]
                s = np.round((tf * (k1 + 1) / (tf + k1 * (1 - b + b * long / max(mean, 1e-9)))) @ weight, 6)
                u, q = np.nonzero((s > 0) & (s >= best.need[None, :]))
                best.add(q, s[u, q], part.iloc[:, 0].to_numpy(dtype=object)[u])
        q, score, got = best.settle()
        yield pd.DataFrame({**{c: np.array([keys[i][j] for i in q], dtype=object) for j, c in enumerate(query)}, unit: got, "score": score})

    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *units.schema]}
    found = units.select(unit, "text").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*query, unit)) + ", score double")
    return top_k(found, k, query, unit)


def fuse(lists: DataFrame, query: tuple[str, ...] = ("q_id",), unit: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: query, unit, score of ranked lists put together (query, unit, rank)."""
    return lists.groupBy(*query, unit).agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))


def minmax(value: Column, w: Window) -> Column:
    """value on the scale of its window from 0 to 1; 1 where all are equal."""
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(1.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of greatest cosine to each query vector, exactly, itself left out.

    Query vectors are taken in blocks of QUERY_BLOCK; each task compares its rows with a block by one matrix product and
    keeps its k best per query before anything is shuffled. Null vectors are left out; a zero vector has cosine 0.
    """
    spark = vectors.sparkSession
    rows = queries.filter(F.col(vector).isNotNull()).select(vec_id, vector).orderBy(vec_id)
    out, block = None, []

    def search(some: list) -> DataFrame:
        ids = np.array([r[0] for r in some])
        m = np.array([r[1] for r in some], dtype=np.float64)
        held = spark.sparkContext.broadcast((ids, m, np.sqrt((m * m).sum(axis=1))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qi, qm, qn = held.value
            best_s, best_i = np.full((len(qi), 0), 0.0), np.full((len(qi), 0), 0)
            for p in batches:
                if not len(p):
                    continue
                x = np.array(p.iloc[:, 1].tolist(), dtype=np.float64)
                vi = p.iloc[:, 0].values
                s = np.round(qm @ x.T / (qn[:, None] * np.sqrt((x * x).sum(axis=1))[None, :] + 1e-10), 6)
                s[qi[:, None] == vi[None, :]] = -np.inf
                best_s, best_i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(vi, s.shape)], axis=1)
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            n = best_s.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(qi, n), "vec_id": best_i.ravel(), "score": best_s.ravel()}).query("score > -inf")

        part = vectors.filter(F.col(vector).isNotNull()).select(vec_id, vector).mapInPandas(run, "query_id long, vec_id long, score double")
        return top_k(part, k, ("query_id",), "vec_id")

    for r in rows.toLocalIterator():
        block.append(tuple(r))
        if len(block) == QUERY_BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(vec_id).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return out


def _reached(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the first row that links lead to; -1 for columns without any."""
    rows, cols = np.full(s.shape[0], -1), np.full(s.shape[1], -1)
    for k in range(len(rows)):
        new = np.array([k]) if rows[k] < 0 else np.array([], dtype=int)
        rows[new] = k
        while len(new):
            c = np.flatnonzero(s[new].any(axis=0) & (cols < 0))
            cols[c] = k
            new = np.flatnonzero(s[:, c].any(axis=1) & (rows < 0))
            rows[new] = k
    return rows, cols


def alike(vectors: DataFrame, least: float, vec_id: str = "vec_id", vector: str = "embedding", block: int = LINK_BLOCK) -> DataFrame:
    """a, b: links that join the same vectors as all pairs of cosine `least` and more do, exactly; least above 0.

    Vectors are hashed into blocks of about `block`, and each pair of blocks is compared in one task. Of its pairs a forest
    goes on, so links grow with the vectors of a task and not with its pairs. vec_id is unique; no vector is null.
    """
    n = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64(vec_id), F.lit(n)).cast("int")
    met = vectors.select(F.col(vec_id).alias("v"), F.col(vector).alias("x"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        first = (p["own"] == p["i"]).values
        last = (p["own"] == p["j"]).values
        v, x = p["v"].values, np.array(p["x"].tolist(), dtype=np.float64).reshape(len(p), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        s = np.zeros((len(a), len(b)), dtype=bool)
        for k in range(0, len(a), 512):
            r = a[k : k + 512]
            s[k : k + 512] = np.round(x[r] @ x[b].T / (norm[r][:, None] * norm[b][None, :] + 1e-10), 6) >= least
        rows, cols = _reached(s)
        on = cols >= 0
        out = pd.DataFrame({"a": np.concatenate([v[a], v[b][on]]), "b": np.concatenate([v[a][rows], v[a][cols[on]]])})
        return out[out["a"] != out["b"]]

    return met.select("v", "x", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).groupBy("i", "j").applyInPandas(run, "a long, b long")


# The parts of the objective of a complementary ranking.
RELEVANCE, NOVELTY, COVERAGE, PAGES = 0.65, 0.15, 0.10, 0.10


def complementary(query: set, ids: list[str], scores: list[float], held: list[set], pages: list[int | None], k: int) -> list[tuple[str, float]]:
    """k candidates chosen one by one: relevance by rank, novelty against those chosen, newly covered query tokens, new page."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    relevance = {i: 1 - r / max(1, 2 * len(ids)) for r, i in enumerate(order)}
    left, chosen, out, covered, seen = set(range(len(ids))), [], [], set(), set()
    while left and len(chosen) < k:

        def worth(i: int) -> float:
            alike = max((len(held[i] & held[j]) / len(held[i] | held[j]) if held[i] and held[j] else 0.0 for j in chosen), default=0.0)
            new = len((held[i] & query) - covered) / max(1, len(query))
            return RELEVANCE * relevance[i] + NOVELTY * (1 - alike) + COVERAGE * new + PAGES * (1.0 if pages[i] and pages[i] not in seen else 0.0)

        best = min(left, key=lambda i: (-round(worth(i), 9), ids[i]))
        out.append((ids[best], worth(best)))
        covered |= held[best] & query
        if pages[best]:
            seen.add(pages[best])
        chosen.append(best)
        left.remove(best)
    return out


def rerank_complementary(candidates: DataFrame, k: int) -> DataFrame:
    """ret_id, chunk_id, rank, objective from candidates: ret_id, question, chunk_id, text, page, score.

    The candidates of one retrieval, a handful, are put in one row and ranked in Arrow batches.
    """
    lists = candidates.groupBy("ret_id", "question").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "score", F.array_distinct(tokens(F.col("text"))).alias("t"), "page"))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for p in batches:
            out = []
            for r, question, c in zip(p.ret_id, p.question, p.c):
                got = complementary(set(re.findall("[a-z0-9]+", (question or "").lower())), [x["chunk_id"] for x in c], [x["score"] for x in c], [set(x["t"]) for x in c], [x["page"] for x in c], k)
                out += [(r, i, n + 1, round(s, 6)) for n, (i, s) in enumerate(got)]
            yield pd.DataFrame(out, columns=["ret_id", "chunk_id", "rank", "objective"])

    return lists.mapInPandas(run, "ret_id long, chunk_id string, rank int, objective double")


def distractors(near: DataFrame, group: DataFrame, least: float, per: int = 2) -> DataFrame:
    """query_id, vec_id, score: up to `per` vectors of another group near each query vector, none for two of them.

    near: query_id, vec_id, score (see nearest); group: vec_id, group, the page or chain of a vector. A vector near to several
    queries goes to the nearest one, the smaller id on ties, before the best of each query are taken.
    """
    g = group.select("vec_id", "group")
    off = near.filter(F.col("score") >= least).join(g.toDF("query_id", "own"), "query_id").join(g, "vec_id").filter(~F.col("own").eqNullSafe(F.col("group")))
    once = off.groupBy("vec_id").agg(F.min_by(F.struct("query_id", "score"), F.struct(-F.col("score"), "query_id")).alias("x")).select("x.query_id", "vec_id", "x.score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per).drop("r")


def vector_clusters(vectors: DataFrame, k: int, seed: int = 42, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster: k-means over the vectors at unit length. Null vectors are left out; fewer vectors than k give as many clusters; none give none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    use = vectors.filter(F.col(vector).isNotNull()).select(vec_id, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    use = use.select(vec_id, array_to_vector(F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).alias("features"))
    n = use.limit(k + 1).count()
    if n == 0:
        return use.select(vec_id, F.lit(0).alias("cluster"))
    model = KMeans(k=max(1, min(k, n)), seed=seed, initMode="k-means||").fit(use) if n > 1 else None
    return model.transform(use).select(vec_id, F.col("prediction").alias("cluster")) if model else use.select(vec_id, F.lit(0).alias("cluster"))
