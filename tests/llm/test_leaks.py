import random

import pytest

from quarry.llm import leaks as L

ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today", "Who jumps?", "The fox"), (2, "too short to find", "", ""), (3, None, None, None), (4, "A B C D E F G H I J K L", "q", "a")]


def brute(items, texts, run=12):
    out = set()
    for d, t in enumerate(texts):
        w = L.words(t) if t else []
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, p, *_ in items:
            x = L.words(p or "")
            if any(tuple(x[k : k + run]) in grams for k in range(len(x) - run + 1)):
                out.add((d, i))
    return out


def found(items, texts, window=L.WINDOW):
    ix = L.build(items)
    return {(t, ix.items[k]) for t, k, *_ in L.scan(ix, texts, window=window)}


@pytest.mark.parametrize("rows", [0, L.ROWS])
def test_equals_brute_force_on_random_texts(monkeypatch, rows):
    monkeypatch.setattr(L, "ROWS", rows)
    r = random.Random(3)
    v = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(v, k=r.randint(8, 40))), "", "") for i in range(30)]
    texts = []
    for _ in range(120):
        t = r.choices(v, k=r.randint(0, 60))
        if r.random() < 0.6:
            x = r.choice(items)[1].split()
            a = r.randrange(len(x))
            t[r.randint(0, len(t)) : 0] = x[a : a + r.randint(9, 15)]
        texts.append(" ".join(t))
    for window in (12, 16, 30):
        assert found(items, texts, window) == brute(items, texts)


def test_edges():
    texts = [None, "", "The qui­ck brown​ fox, JUMPS over the lazy dog near the OLD river!", "the quick brown fox jumps over the lazy dog near the river", "a b c d e f g h i j k l", "x " * 200_000 + ITEMS[0][1]]
    assert found(ITEMS, texts) == brute(ITEMS, texts) == {(2, 1), (4, 4), (5, 1)}
    assert found([], texts) == set() and found(ITEMS, []) == set()


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 2)  # several indexes
    d = spark.createDataFrame([(7, "say " + ITEMS[0][1]), (7, "say " + ITEMS[0][1]), (8, None), (9, "a b c d e f g h i j k l m")], "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, passage string, question string, answer string")
    got = L.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, 1), (9, 4)} and len(got) == 2
    assert next(r for r in got if r.item_id == 1).answer_overlap == 1.0
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_batches_are_cut_by_characters():
    import pandas as pd

    from quarry.llm.batches import parts

    p = pd.DataFrame({"i": range(6), "t": ["aa", None, "bbbb", "c" * 99, "", "dd"]})
    got = list(parts(iter([p, p.iloc[:0]]), chars=5))
    assert [g.i.tolist() for g in got] == [[0, 1], [2], [3], [4, 5], []]


def test_five_thousand_items_are_one_index_and_equal_brute_force(spark):
    r = random.Random(11)
    v = [f"w{i}" for i in range(4000)] + ["the", "of", "and", "to"] * 400
    items = [(i, " ".join(r.choices(v, k=r.randint(10, 40))), "", "") for i in range(5000)]
    texts = []
    for _ in range(60):
        t = r.choices(v, k=60)
        if r.random() < 0.7:
            x = r.choice(items)[1].split()
            a = r.randrange(len(x))
            t[20:20] = x[a : a + r.randint(10, 15)]
        texts.append(" ".join(t))
    assert L.ITEMS >= 5000 and found(items, texts) == brute(items, texts)
