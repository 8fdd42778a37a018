import difflib
import random

from quarry.operators import alignment as A
from quarry.operators.components import components


def brute(document, fact, threshold):
    want, best = " ".join(fact).lower(), None
    for s in range(len(document)):
        for d in (-2, -1, 0, 1, 2):
            e = s + len(fact) + d
            if e <= len(document) and e - s >= max(1, len(fact) // 2):
                r = A.ratio(" ".join(document[s:e]).lower(), want)
                if r >= threshold and (best is None or r > best[2]):
                    best = (s, e, r)
    return best


def test_ratio_is_by_common_subsequence():
    assert A.ratio("abcd", "abcd") == 100 and A.ratio("", "") == 100 and A.ratio("ab", "") == 0
    r = random.Random(1)
    for _ in range(100):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert A.common_length(a, b) == t[-1][-1]
    assert difflib.SequenceMatcher(None, "abc", "abc").ratio() == 1.0


def test_nearest_window_equals_trying_all():
    r = random.Random(2)
    words = ["turbine", "pressure", "repair", "the", "of", "storage", "valve", "limit", "checked", "weekly"]
    for _ in range(40):
        doc = r.choices(words, k=40)
        a = r.randrange(30)
        fact = list(doc[a : a + 7])
        w = fact[r.randrange(7)]
        fact[fact.index(w)] = w[:-1] + "x"
        got, want = A.nearest_window(doc, fact, 80), brute(doc, fact, 80)
        assert got and want and round(got[2], 6) == round(want[2], 6)
    assert A.nearest_window([], ["a"]) is None and A.nearest_window(["a"], []) is None
    assert A.nearest_window(words, ["nothing", "alike", "herein"]) is None


def test_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("f", "e"), ("a", "d"), ("g", "g")], "a string, b string")
    got = {r.node: r.group for r in components(nodes, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}
    assert {r.group for r in components(nodes, links.limit(0)).collect()} == set("abcdefgh")
