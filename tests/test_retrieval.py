import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.plans import registry


def brute(query, docs, k1=1.5, b=0.75):
    t = {i: re.findall("[a-z0-9]+", x.lower()) for i, x in docs.items()}
    n, avg = len(t), sum(map(len, t.values())) / max(1, len(t))
    df = Counter(w for x in t.values() for w in set(x))
    out = {}
    for i, x in t.items():
        tf = Counter(x)
        s = [math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(x) / avg)) for w in set(re.findall("[a-z0-9]+", query.lower())) if tf[w]]
        if s:
            out[i] = round(sum(s), 6)
    return out


DOCS = {"a": "the weld is dry and the weld holds", "b": "a dry gas", "c": "turbine blades", "d": "Weld! weld? WELD", "e": ""}


def test_bm25_equals_brute_force(spark):
    units = spark.createDataFrame(list(DOCS.items()), "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "dry weld weld"), ("q2", "nothing known"), ("q3", "")], "q_id string, text string")
    got = {(r.q_id, r.chunk_id): r.score for r in R.bm25(asked, units).collect()}
    want = {("q1", i): s for i, s in brute("dry weld weld", DOCS).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    top = R.top_k(R.bm25(asked, units), 2).orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2]


def test_best_units_equal_the_ranked_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    units = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(300)] + [("x", None), ("y", "")], "chunk_id string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 4))) for i in range(20)] + [("none", "unknown"), ("null", None), ("q0", "W1 w2")], "q_id string, text string")
    asked = asked.filter("q_id <> 'q0' or text <> 'W1 w2'")
    want = sorted(map(tuple, R.top_k(R.bm25(asked, units), 7).select("q_id", "chunk_id", "score", "rank").collect()))
    monkeypatch.setattr(R, "UNITS", 16)
    got = sorted(map(tuple, R.bm25_top(asked, units, 7).select("q_id", "chunk_id", "score", "rank").collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    monkeypatch.setattr(R, "QUERIES", 3)
    assert sorted(map(tuple, R.bm25_top(asked, units, 7).select("q_id", "chunk_id", "score", "rank").collect())) == want
    monkeypatch.setattr(R, "QUERIES", 2000)
    assert R.bm25_top(asked.limit(0), units, 7).count() == 0 and R.bm25_top(asked, units.limit(0), 7).count() == 0


def test_bm25_within_groups(spark):
    units = spark.createDataFrame([("a", 1, "dry weld"), ("b", 1, "gas"), ("c", 2, "dry weld"), ("d", 2, "dry dry")], "chunk_id string, doc_id long, text string")
    asked = spark.createDataFrame([("q", 1, "dry")], "q_id string, doc_id long, text string")
    got = {r.chunk_id: r.score for r in R.bm25(asked, units, ("doc_id",)).collect()}
    assert got == {"a": brute("dry", {"a": "dry weld", "b": "gas"})["a"]}


def test_nearest_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype("float32")
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r.rank): r.vec_id for r in R.nearest(v, v.filter("vec_id % 10 = 0"), 4).collect()}
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = n @ n.T
    np.fill_diagonal(s, -9)
    assert got == {(q, k + 1): int(i) for q in range(0, 60, 10) for k, i in enumerate(np.argsort(-s[q])[:4])}
    assert R.nearest(v, v.filter("vec_id < 0"), 4).count() == 0


def test_fusion_and_minmax(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1)], "q_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in R.fuse(lists).collect()}
    assert got == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6)}


def test_complementary_prefers_new_pages():
    ids, t = ["a", "b", "c"], [{"x", "y"}, {"x", "y"}, {"z"}]
    got = R.complementary({"x", "z"}, ids, [3.0, 2.9, 1.0], t, [1, 1, 2], 2)
    assert [i for i, _ in got] == ["a", "c"]
    assert R.complementary(set(), [], [], [], [], 3) == []


@pytest.mark.parametrize("rel,rw,prec5", [([1], 1, 0.2), ([3], 1 / 3, 0.2), ([1, 4], 0.75, 0.4), ([], 0, 0)])
def test_rank_weighted_precision(spark, rel, rw, prec5):
    d = spark.createDataFrame([(rel,)], "r array<int>").select(M.rank_weighted(F.col("r")).alias("w"), M.precision_at(F.col("r"), 5).alias("p"), M.ndcg_at(F.col("r"), 5).alias("n")).first()
    assert (round(d.w, 9), round(d.p, 9)) == (round(rw, 9), prec5) and 0 <= d.n <= 1


def test_relevance_ignores_unknown_questions(spark):
    ranked = spark.createDataFrame([(1, "q", "bm25", 1, "a"), (1, "q", "bm25", 2, "b"), (2, "other", "bm25", 1, "a")], "ret_id long, q_id string, mode string, rank int, chunk_id string")
    gold = spark.createDataFrame([("q", "b"), ("q", "z")], "q_id string, chunk_id string")
    r = M.relevance(ranked, gold).collect()
    assert [(x.ret_id, x.n, x.n_gold, x.rel) for x in r] == [(1, 2, 2, [2])]
    at = {x.k: x for x in M.at_all(M.relevance(ranked, gold)).collect()}
    assert at[1].recall == 0 and at[3].recall == 0.5 and at[10].mrr == 0.5


@pytest.mark.parametrize("block", [7, 4096])
def test_vector_groups_equal_brute_force(spark, tmp_path, monkeypatch, block):
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(60, 12)), 3)
    m[7] = 0
    unit = m / np.maximum(1e-9, np.linalg.norm(m, axis=1))[:, None]
    near = np.round(unit @ unit.T, 6) >= 0.3
    group = np.arange(60)
    for _ in range(60):
        group = np.array([min(group[i], group[near[i]].min(initial=i)) for i in range(60)])
    rows = [(i, [float(x) for x in m[i]]) for i in range(60)]
    spark.createDataFrame(rows + rows[:5] + [(99, None)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(R.alike, "__defaults__", ("vec_id", "embedding", block))
    got = {r.group: r.n for r in registry.queries()["gr_vector_groups"](spark, str(tmp_path)).collect()}
    assert got == {int(g): int((group == g).sum()) for g in np.unique(group)} and len(got) > 1


def test_layers_equal_brute_force(spark):
    texts = {"a": "the weld is dry and clean", "b": "a dry clean weld is the best and so on", "c": "turbine blades turn", "d": "the weld is dry", "e": None}
    ranked = spark.createDataFrame([(1, "q", "b"), (1, "q", "c"), (1, "q", "b"), (2, "q", "a"), (3, "q", "zz"), (4, "other", "a")], "ret_id long, q_id string, chunk_id string")
    required = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "zz")], "q_id string, chunk_id string")
    t = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = {(r.ret_id, r.chunk_id): (r.retrieved, r.in_words, r.by_vector) for r in M.layers(ranked, required, t).collect()}

    def present(x, held):
        a, b = Counter(texts[x].split()), Counter(texts[held].split())
        cosine = sum(a[w] * b[w] for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return len(set(a) & set(b)) / len(a) >= M.IN_WORDS, cosine >= M.BY_VECTOR

    lists = {1: ["b", "c"], 2: ["a"], 3: ["zz"]}
    for ret, held in lists.items():
        for x in ("a", "c", "zz"):
            found = [present(x, h) for h in held if texts.get(x) and texts.get(h)]
            assert got[ret, x] == (x in held, any(f[0] for f in found), any(f[1] for f in found))
    assert len(got) == 9
    sums = {r.ret_id: r for r in M.layered(M.layers(ranked, required, t)).collect()}
    assert sums[2].recall == round(1 / 3, 6) and sums[1].text_recall_any >= sums[1].strict_recall
    assert M.layers(ranked.limit(0), required, t).count() == 0


def test_groups_are_met_whole(spark):
    ranked = spark.createDataFrame([(1, "q", "f0"), (2, "q", "f0"), (2, "q", "f1"), (2, "q", "f2")], "ret_id long, q_id string, chunk_id string")
    groups = spark.createDataFrame([("q", "f0", 0), ("q", "f1", 1), ("q", "f2", 1)], "q_id string, chunk_id string, grp int")
    got = {r.ret_id: (r.n_groups, r.group_recall, r.joint) for r in M.group_recall(ranked, groups).collect()}
    assert got == {1: (2, 0.5, False), 2: (2, 1.0, True)}


def test_retriever_by_name(spark):
    from quarry.plans.retrieval_queries import retriever

    t = spark.createDataFrame([(1, "dry weld"), (2, "dry gas"), (3, "blades")], "chunk_id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = t.filter("chunk_id = 1").withColumnRenamed("chunk_id", "q_id")
    assert [r.chunk_id for r in retriever("bm25")(asked, t, 1).collect()] == [1]
    assert [r.vec_id for r in retriever("dense")(v.filter("vec_id = 1"), v, 1).collect()] == [2]
    got = retriever("hybrid")((asked, v.filter("vec_id = 1")), (t, v), 2).collect()
    assert {(r.chunk_id, r["rank"]) for r in got} == {("2", 1), ("1", 2)}
    with pytest.raises(ValueError):
        retriever("none")


def test_distractors_are_of_another_group_and_used_once(spark):
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.1), (2, 11, 0.85), (2, 12, 0.7), (2, 14, 0.6)], "query_id long, vec_id long, score double")
    group = spark.createDataFrame([(1, 0), (2, 0), (10, 0), (11, 1), (12, 1), (13, 1), (14, None)], "vec_id long, group int")
    got = {tuple(r) for r in R.distractors(near, group, 0.5, 2).collect()}
    assert got == {(2, 11, 0.85), (1, 12, 0.7), (2, 14, 0.6)}


def test_vector_clusters_find_blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.05, 4) + np.eye(4)[i % 3]]) for i in range(90)] + [(900, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in R.vector_clusters(v, 3).collect()}
    assert set(got) == set(range(90)) and all(len({got[i] for i in range(k, 90, 3)}) == 1 for k in range(3)) and len(set(got.values())) == 3
    assert R.vector_clusters(v.limit(0), 3).count() == 0 and R.vector_clusters(v.filter("vec_id < 2"), 3).count() == 2


def test_layers_compare_texts_of_few_pairs(spark, monkeypatch):
    rng, compared, plain = np.random.default_rng(5), [], M.overlaps
    words = np.array([f"w{i}" for i in range(400)])
    texts = {f"c{i}": " ".join(rng.choice(words, int(rng.integers(1, 60)))) for i in range(60)} | {"one": "w1 " * 700 + "w2 w2 w3", "none": "- -"}
    texts |= {f"{k}_near": v + " w1" for k, v in list(texts.items())[:25]}
    names = list(texts)
    lists = {i: list(dict.fromkeys(rng.choice(names, 12))) for i in range(40)}
    required = {f"q{i}": list(dict.fromkeys([*rng.choice(names, 3), "one", "none"])) for i in range(10)}
    monkeypatch.setattr(M, "overlaps", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    got = M.layers(
        spark.createDataFrame([(i, f"q{i % 10}", c) for i, cs in lists.items() for c in cs], "ret_id long, q_id string, chunk_id string"),
        spark.createDataFrame([(k, c) for k, cs in required.items() for c in cs], "q_id string, chunk_id string"),
        spark.createDataFrame(list(texts.items()), "chunk_id string, text string"),
    )
    count = {k: Counter(re.findall("[a-z0-9]+", v)) for k, v in texts.items()}

    def near(x, y):
        a, b = count[x], count[y]
        dot, size = sum(a[w] * b[w] for w in a), math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return bool(a) and round(len(a.keys() & b.keys()) / len(a), 6) >= M.IN_WORDS, size > 0 and round(dot / size, 6) >= M.BY_VECTOR

    want = {(i, x): (x in held, any(near(x, y)[0] for y in held), any(near(x, y)[1] for y in held)) for i, held in lists.items() for x in required[f"q{i % 10}"]}
    assert {(r.ret_id, r.chunk_id): (r.retrieved, r.in_words, r.by_vector) for r in got.collect()} == want
    pairs = {(x, y) for i, held in lists.items() for x in required[f"q{i % 10}"] for y in held if x != y}
    assert {len(x) for x in (want.values())} == {3} and any(v[1] and not v[0] for v in want.values())
    assert len(compared) == 1 and compared[0] < 0.2 * len(pairs)
