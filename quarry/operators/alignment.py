"""Where a fact stands in its document: exactly, or as near as its characters allow."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_ANCHORS = frozenset("the a an and or but if is are was were of to in on for by with as at be this that these those it its their".split())
THRESHOLD = 85.0


def exact(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """fact_id, char_start, char_end of the first place where the document holds the fact's text; none where it doesn't."""
    rows = facts.select("fact_id", "doc_id", "text").join(documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    at = F.instr("body", F.col("text"))
    return rows.withColumn("at", at).filter("at > 0").select("fact_id", (F.col("at") - 1).alias("char_start"), (F.col("at") - 1 + F.length("text")).alias("char_end"))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    s = (1 << len(a)) - 1
    full = s
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Likeness from 0 to 100 by insertions and deletions; 100 for two empty texts."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def nearest_window(document: list[str], fact: list[str], threshold: float = THRESHOLD) -> tuple[int, int, float] | None:
    """(start, end, likeness) of the window of tokens most like the fact, two tokens longer or shorter at most.

    Windows are tried where a trigram of one of the fact's three longest words stands, two tokens to either side.
    """
    if not fact or not document:
        return None
    low = [t.lower() for t in document]
    places: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(low):
        for k in range(len(t) - 2):
            places[t[k : k + 3]].append(i)
    anchors = sorted((i for i, t in enumerate(fact) if t.lower() not in STOP_ANCHORS and len(t) > 2), key=lambda i: (-len(fact[i]), i))[:3]
    votes: Counter = Counter()
    for a in anchors:
        t = fact[a].lower()
        for k in range(len(t) - 2):
            for p in places.get(t[k : k + 3], ()):
                votes[p - a] += 1
    starts = np.array(sorted({max(0, s + d) for s in votes for d in (-2, -1, 0, 1, 2)}), dtype=np.int64)
    want = " ".join(fact).lower()
    letters = {c: i for i, c in enumerate(sorted(set(want)))}
    counts = np.zeros((len(low) + 1, len(letters)), dtype=np.int32)
    for i, t in enumerate(low):
        for c in t + " ":
            if c in letters:
                counts[i + 1, letters[c]] += 1
    counts = np.cumsum(counts, axis=0)
    sizes = np.cumsum([0, *(len(t) + 1 for t in low)])
    have = np.bincount([letters[c] for c in want], minlength=len(letters))
    s = np.repeat(starts, 5)
    e = s + np.tile(np.arange(-2, 3), len(starts)) + len(fact)
    ok = (e - s >= max(1, len(fact) // 2)) & (e <= len(low))
    s, e = s[ok], e[ok]
    shared = np.minimum(counts[e] - counts[s], have).sum(axis=1)
    bound = 200.0 * shared / (sizes[e] - sizes[s] - 1 + len(want))  # no order of the same characters is more alike
    best: tuple[int, int, float] | None = None
    for k in np.lexsort((e, s, -bound)):
        if bound[k] < (best[2] if best else threshold):
            break
        r = ratio(" ".join(low[s[k] : e[k]]), want)
        if r >= threshold and (best is None or (-r, s[k], e[k]) < (-best[2], best[0], best[1])):
            best = (int(s[k]), int(e[k]), r)
    return best


def fuzzy(facts: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """fact_id, token_start, token_end, likeness for facts that aren't in their document word by word, in Arrow batches."""
    rows = facts.select("fact_id", "doc_id", "text").join(documents.select("doc_id", F.col("text").alias("body")), "doc_id").filter(F.instr("body", F.col("text")) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [(i, *w) for i, t, b in zip(p.fact_id, p.text, p.body) if (w := nearest_window(b.split(), t.split(), threshold))]
            yield pd.DataFrame(got, columns=["fact_id", "token_start", "token_end", "likeness"])

    return rows.select("fact_id", "text", "body").mapInPandas(run, "fact_id string, token_start int, token_end int, likeness double")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens that a and b share, repeats counted on both sides."""
    count = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, n: s + n)
