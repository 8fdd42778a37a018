import itertools
import random
import re

import numpy as np
import pytest

from quarry.llm import neardup as N


def brute(rows, s=0.8):
    w = {}
    for i, t in rows:
        if i is not None and t is not None and (x := frozenset(re.findall(r"[^\W_]+", t.lower()))):
            w.setdefault(i, set()).add(x)
    return {(a, b) for a, b in itertools.combinations(sorted(w), 2) if any(len(x & y) / len(x | y) >= s - 1e-12 for x in w[a] for y in w[b])}


def texts(n, seed, vocabulary=60):
    r = random.Random(seed)
    base = [" ".join(r.choices([f"w{i}" for i in range(vocabulary)], k=r.randint(3, 14))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = f"w{r.randrange(vocabulary)}"
        r.shuffle(t)
        out.append((f"q{i:04d}", " ".join(t)))
    return out


def found(spark, rows, s=0.8):
    d = spark.createDataFrame(rows, "q_id string, question string, extra int") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "q_id string, question string")
    m, l = N.near_duplicates(d, "q_id", "question", s)
    return {tuple(r) for r in N.pairs(m, l).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(240, seed)
    assert found(spark, rows) == brute(rows)


def test_hot_words_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 5)
    monkeypatch.setattr(N, "BLOCK", 20)
    rows = texts(200, 7, 14)
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [("a", "One two"), ("a", "One two"), ("b", "two ONE!"), ("c", None), ("d", ""), ("e", "?!"), (None, "One two"), ("f", "ein " * 5000), ("g", "ein")]
    assert found(spark, rows) == brute(rows) == {("a", "b"), ("f", "g")}
    assert found(spark, [r for r in rows if r[0] == "c"]) == set()


def test_gray_rank_is_the_inverse_of_the_gray_code():
    b = np.arange(4096, dtype=np.uint64)
    assert (N.gray_rank(b ^ (b >> np.uint64(1))) == b).all()


def test_index_loses_no_close_pair():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, (20, 2), dtype=np.uint64)
    codes = base[r.integers(0, 20, 300)].copy()
    for row in codes:
        for _ in range(r.integers(0, 4)):
            row[r.integers(2)] ^= np.uint64(1) << np.uint64(r.integers(64))
    n = np.full(300, 18)
    i, j = N.near(np.zeros(300, int), codes, n, np.zeros(300, int), np.zeros(300, bool), 0.8)
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if np.bitwise_count(codes[a] ^ codes[b]).sum() <= 4}
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == want


def test_many_buckets_at_once():
    r = np.random.default_rng(6)
    key = np.repeat(np.arange(60), r.integers(1, 40, 60))
    codes = r.integers(0, 2**63, (12, 2), dtype=np.uint64)[r.integers(0, 12, len(key))]
    codes[:, 0] ^= np.uint64(1) << r.integers(0, 64, len(key)).astype(np.uint64)
    n, block, cross = np.full(len(key), 18), r.integers(0, 2, len(key)), key % 3 == 0
    i, j = N.near(key, codes, n, block, cross, 0.8)
    got = [tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a, b in itertools.combinations(range(len(key)), 2) if key[a] == key[b] and np.bitwise_count(codes[a] ^ codes[b]).sum() <= 4 and (not cross[a] or block[a] != block[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_large_classes_and_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = texts(150, 9, 20) + [(f"c{i:03d}", "one question asked by many users again and again") for i in range(80)] + [(f"d{i:03d}", "one question asked by many users again and often again") for i in range(30)]
    assert found(spark, rows) == brute(rows)
