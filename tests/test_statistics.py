"""Bootstrap and rank correlation against brute force."""

import itertools
import math
import random

import numpy as np

from quarry.plans import stats_queries as S


def brute(cells):
    rows = [(x, y) for x, y, c in cells for _ in range(c)]
    agree = a = b = 0
    for (x, y), (u, v) in itertools.combinations(rows, 2):
        s, t = (x > u) - (x < u), (y > v) - (y < v)
        agree, a, b = agree + s * t, a + abs(s), b + abs(t)
    return len(rows), round(agree / math.sqrt(a * b), 6) if a and b else None


def test_tau_equals_brute_force():
    r = random.Random(3)
    for k in (1, 2, 5, 30):
        cells = {(r.randrange(6), r.randrange(6)): r.randint(1, 4) for _ in range(k)}
        cells = [(x, y, c) for (x, y), c in cells.items()]
        assert S.kendall(cells) == brute(cells)
    assert S.kendall([]) == (0, None)
    assert S.kendall([(1, 2, 5)]) == (5, None)


def test_interval_is_as_wide_as_of_a_true_resample(spark, data):
    rows = S._rp(spark, data).groupBy("mode", "q_id").agg({"r": "avg"}).toDF("mode", "q_id", "v").collect()
    got = {x["mode"]: x.hi - x.lo for x in S.ag_bootstrap(spark, data).collect()}
    rng = np.random.default_rng(4)
    for mode, width in got.items():
        v = np.array([x.v for x in rows if x["mode"] == mode])
        if len(v) >= 20 and v.std() > 0:
            lo, hi = np.quantile([rng.choice(v, len(v)).mean() for _ in range(2000)], [0.025, 0.975])
            assert 0.85 <= width / (hi - lo) <= 1.18
