from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import packing as P


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_configurations_hold_exactly_all(histogram):
    got = P.configurations(histogram, 64, rounds=20)
    held = Counter()
    for a, t in got:
        assert t > 0 and sum(l * n for l, n in a.items()) <= 64
        for l, n in a.items():
            held[l] += n * t
    assert held == Counter(histogram)


def test_close_to_the_least_number():
    h = {33: 300, 31: 300, 20: 200, 22: 400, 7: 500, 3: 800}
    used = sum(t for _, t in P.configurations(h, 64))
    assert used <= 1.02 * -(-sum(l * n for l, n in h.items()) // 64)


def test_best_configuration_fills():
    import numpy as np

    l = np.array([3, 7, 20, 31, 33])
    assert sum(int(l[k]) * n for k, n in P.best_configuration(l, l / 64, 64).items()) == 64


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    c = spark.createDataFrame([(i, (i * 37) % 90) for i in range(400)] + [(1000, 530)] + [(2000 + i, 17) for i in range(300)], "doc_id long, tokens long")
    got = P.pack(c, 100)
    full = got.groupBy("container").agg(F.sum("tokens").alias("s"))
    assert full.filter("s > 100").count() == 0 and got.groupBy("doc_id", "piece").count().filter("count > 1").count() == 0
    total = c.agg(F.sum("tokens")).first()[0]
    assert got.agg(F.sum("tokens")).first()[0] == total and full.count() <= 1.05 * total / 100 + 1
    cut = [(r.piece, r.token_start, r.tokens) for r in got.filter("doc_id = 1000").orderBy("piece").collect()]
    assert cut == [(k, 100 * k, 100) for k in range(5)] + [(5, 500, 30)]
    assert got.filter("piece > 0").select("doc_id").distinct().count() == 1
    assert P.pack(c.limit(0), 100).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "Hello world, hello"), (2, None), (3, ""), (None, "x"), (1, "Hello world, hello"), (4, "<|endoftext|> ä" * 2000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in P.token_counts(d).collect()}
    assert got[1] == 4 and got[3] == 0 and set(got) == {1, 3, 4} and got[4] > 4000


def test_program_covers_all_and_its_bound_holds():
    import numpy as np

    l, h = np.array([3, 7, 20, 22, 31, 33]), np.array([800, 500, 200, 400, 300, 300])
    uses, bound = P.program(l, h, 64)
    cover = np.zeros(6)
    for key, x in uses.items():
        assert sum(l[k] * n for k, n in key) <= 64
        for k, n in key:
            cover[k] += n * x
    assert (cover >= h - 1e-6).all() and (l * h).sum() / 64 - 1 <= bound <= sum(uses.values())


def test_large_histograms_are_within_a_percent_of_the_bound_and_mostly_from_the_program():
    import numpy as np

    rng = np.random.default_rng(2)
    h = {int(l): int(n) for l, n in zip(range(5, 400), rng.poisson(3000, 395))}
    found, bound = P.solve(h, 512)
    n = {s: sum(t for x, _, t in found if x == s) for s in ("whole", "priced", "greedy")}
    assert sum(n.values()) <= 1.01 * bound and n["greedy"] <= 0.02 * sum(n.values())


def test_many_sizes(spark):
    d = spark.createDataFrame([(i, "word " * (i % 40 + 1)) for i in range(60)], "doc_id long, text string")
    sizes = spark.createDataFrame([(f"p{c}", c) for c in range(30, 38)] + [(None, 9), ("x", None), ("y", 0)], "pack_id string, capacity int")
    got = P.pack_all(d, sizes)[0].groupBy("pack_id").agg(F.sum("tokens").alias("n")).collect()
    assert len(got) == 8 and len({r.n for r in got}) == 1
    assert P.pack_all(d, sizes.limit(0))[0].count() == 0
