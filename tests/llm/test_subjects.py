import random

import pytest

from quarry.llm import linear as L
from quarry.llm import subjects as S

BANKS = {"law": "court statute tenant clause judge appeal lease".split(), "sport": "goal match league striker referee trophy cup".split(), "energy": "turbine grid boiler voltage dam battery steam".split()}


def sentence(r, subject):
    return "The " + " ".join(r.choices(BANKS[subject], k=5)) + f" of Name{r.randrange(999)} is noted."


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    rows = []
    for k in range(120):
        s = r.choice(list(BANKS))
        said = s if r.random() > 0.08 else r.choice(list(BANKS))
        rows.append((" ".join(sentence(r, s) for _ in range(8)), (said,)))
    return S.fit(rows, sorted(BANKS), [t for t, _ in rows[:30]])


def test_held_out_documents(model):
    r = random.Random(2)
    good = 0
    for _ in range(100):
        a, b, c = r.sample(list(BANKS), 3)
        text = " ".join([sentence(r, a) for _ in range(5)] + [sentence(r, b) for _ in range(4)] + [sentence(r, c)])
        part, n = S.shares(model, [text])
        good += n[0] == 10 and {model.subjects[k] for k in (part[0] >= S.SHARE).nonzero()[0]} == {a, b}
    assert good >= 92


def test_sentences():
    got = S.split("See cf. Fig. 4.7 of it, e.g. series 5. Is it true that all is well? Yes it is all well.\n\nScope\n| a | b |\nIn practice the weld-\ning goes on and on.")
    assert len(got) == 4 and got[-1][:3] == ["in", "practice", "the"] and "scope" not in got[-1]
    assert S.split("") == [] and S.split("| x |\n| y |") == []


def test_operator(spark, model):
    d = spark.createDataFrame([(1, "The court statute tenant clause is noted. The judge appeal lease court is noted.", "x"), (2, None, "x"), (3, "", "x"), (1, "The court statute tenant clause is noted. The judge appeal lease court is noted.", "x")], "doc_id long, text string, subject string")
    assert [(r.doc_id, r.subject) for r in S.classify(d, model).collect()] == [(1, "law")]
    assert S.classify(d.limit(0), model).count() == 0


def test_no_labels(spark):
    m = S.fit([], ["law"])
    assert S.shares(m, ["The court statute tenant clause is noted."])[0].sum() == 0


def test_threshold():
    import numpy as np

    t = L.best_threshold(np.array([0.9, 0.8, 0.4, 0.2]), np.array([True, True, False, False]))
    assert 0.4 < t < 0.8


def test_sentences_are_drawn_from_all_documents():
    t = S.sentences([" ".join(f"The {w} of plant {d} is read daily." for w in ("valve", "meter", "gauge", "motor", "shaft")) for d in range(400)])
    few = S.drawn(t, 1000)
    assert len(few.doc) == 1000 and 350 < (few.doc >= 200).sum() < 650 and (few.doc[1:] >= few.doc[:-1]).all()
    first = int((t.doc < few.doc[0]).sum())
    some = {tuple(t.codes[a:b]) for a, b in zip(t.starts, t.starts[1:])}
    assert all(tuple(few.codes[a:b]) in some for a, b in zip(few.starts, few.starts[1:])) and few.starts[-1] == len(few.codes) and first < 100


def test_fit_draws_its_sentences(monkeypatch):
    seen = []
    monkeypatch.setattr(S, "SENTENCES", 40)
    features = S.features
    monkeypatch.setattr(S, "features", lambda t: seen.append(t) or features(t))
    rows = [(f"The valve of plant number {k} is read daily here.", ("a" if k % 2 else "b",)) for k in range(50)]
    S.fit(rows, ["a", "b"], [f"The meter of shop number {k} is read daily here." for k in range(200)], rounds=1)
    assert len(seen[0].doc) == 40 and (seen[0].doc >= 40).sum() > 10
