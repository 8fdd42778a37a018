"""Near-duplicate short texts: a Gray-order hierarchical index over bit fingerprints of word sets.

Every word toggles one of 128 bits of its text's fingerprint, so two fingerprints differ in no more bits than the word
sets differ in words. Sets with shared words / all words >= s differ in at most (1 - s) / (1 + s) of their summed sizes;
a pair whose fingerprints differ in more bits can be dropped unseen, and no true pair ever is.

The index is spread over the cluster by rare words: sets that similar share one of their rarest words (a prefix of the
words in order of frequency). Each bucket of such a word, whatever its size, is an index of its own: fingerprints in Gray
order, upper nodes holding the bits their members share, node pairs dropped by the differences they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.skew import HOT_SHARE, skew_join
from quarry.session import stored

#: Words in more sets than this don't key a bucket alone but together with a second word.
COMMON = 2000
#: Rows of a bucket, or of one side of a pair of blocks, that one task holds at once.
BLOCK = 4096
_KEY = ["k", "bi", "bj"]


def words(text: Column) -> Column:
    """The distinct words, sorted: longest runs of letters and digits in lower-cased text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    r = code.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1)


def near(key: np.ndarray, codes: np.ndarray, n: np.ndarray, block: np.ndarray, cross: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one bucket whose codes differ in few enough bits and whose sizes fit; codes: (rows, 2) uint64.

    key: the bucket of each row, equal keys together. Each bucket is a tree of its own, all trees are built and searched at
    once: rows are put in Gray order, and each level of upper nodes keeps the bits shared by all below. From the roots on,
    pairs of nodes are split into pairs of children unless their shared bits already differ too much.
    cross: of a row's bucket only pairs from different blocks count.
    """
    none = np.zeros(0, np.int64)
    if len(key) < 2:
        return none, none
    allow = (1 - s) / (1 + s)
    hi, lo = gray_rank(codes[:, 0]), gray_rank(codes[:, 1])
    lo = np.where(hi & np.uint64(1), ~lo, lo)  # the second word runs backwards after an odd first
    tree = np.r_[0, np.cumsum(key[1:] != key[:-1])]
    order = np.lexsort((lo, hi, tree))
    c, m, b, x = codes[order], n[order], block[order], cross[order]
    levels = [(c, c, m, tree, None)]  # shared ones, any ones, largest size, tree, place of the first child below
    roots = []
    while True:
        a, o, k, t, _ = levels[-1]
        first = np.r_[True, t[1:] != t[:-1]]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(t)])
        roots.append(starts[(sizes == 1)] if len(levels) > 1 else none)
        if (sizes == 1).all():
            break
        inside = np.arange(len(t)) - np.repeat(starts, sizes)
        live = np.repeat(sizes > 1, sizes)  # a tree that has come to its root stays there
        up = np.flatnonzero(live & (inside % 2 == 0))
        ends = np.minimum(np.r_[up[1:], len(t)], up + 2)
        pair = np.where((ends - up > 1) & (np.minimum(up + 1, len(t) - 1) < len(t)) & (t[np.minimum(up + 1, len(t) - 1)] == t[up]), np.minimum(up + 1, len(t) - 1), up)
        levels.append((a[up] & a[pair], o[up] | o[pair], np.maximum(k[up], k[pair]), t[up], np.stack([up, pair], axis=1)))
    found, stack = [], [(level, r, r) for level, r in enumerate(roots) if len(r)]
    while stack:
        level, u, v = stack.pop()
        if len(u) > 1 << 17:
            h = len(u) // 2
            stack += [(level, u[:h], v[:h]), (level, u[h:], v[h:])]
            continue
        ands, ors, most, _, below = levels[level]
        shared = ~(ands[u] ^ ors[u]) & ~(ands[v] ^ ors[v])
        keep = _bits((ands[u] ^ ands[v]) & shared) <= (most[u] + most[v]) * allow + 1e-9
        u, v = u[keep], v[keep]
        if level == 0:
            small, large = np.minimum(m[u], m[v]), np.maximum(m[u], m[v])
            ok = (small >= s * large - 1e-9) & ((b[u] != b[v]) | ~x[u])
            found.append((order[u[ok]], order[v[ok]]))
        elif len(u):
            (u0, u1), (v0, v1) = below[u].T, below[v].T
            cu, cv = np.concatenate([u0, u0, u1, u1]), np.concatenate([v0, v1, v0, v1])
            two_u, two_v, same = u0 != u1, v0 != v1, u == v
            real = np.concatenate([np.ones(len(u), bool), two_v, two_u & ~same, two_u & two_v])  # children that are there, each pair once
            ok = real & ((cu != cv) if level == 1 else True)
            stack.append((level - 1, cu[ok], cv[ok]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def _search(s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def pairs(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
            starts = np.flatnonzero(np.r_[True, (p[_KEY].values[1:] != p[_KEY].values[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(p)])
            codes = np.stack([p.hi.values.view(np.uint64), p.lo.values.view(np.uint64)], axis=1)
            n, block, sid = p.n.values.astype(np.int64), p.b.values, p.sid.values
            cross = (p.bi != p.bj).values
            i, j = near(np.repeat(np.arange(len(starts)), sizes), codes, n, block, cross, s)
            if len(i):
                x, y = sid[i], sid[j]
                swap = x > y
                out = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})
                yield out[out.a != out.b].drop_duplicates()

        for p in batches:
            if not len(p):
                continue
            p = pd.concat([*rest, p], ignore_index=True) if rest else p.reset_index(drop=True)
            last = p[_KEY].iloc[-1].values
            whole = (p[_KEY].values != last).any(axis=1)
            cutoff = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
            rest = [p.iloc[cutoff:]]
            if cutoff:
                yield from pairs(p.iloc[:cutoff].reset_index(drop=True))
        if rest and len(rest[0]):
            yield from pairs(rest[0].reset_index(drop=True))

    return run


def sets(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, sid, ws: the word set of each row with any word. Rows of one sid have the same set (copies, reorderings)."""
    w = rows.select(F.col(row_id).alias("id"), words(F.col(text)).alias("ws")).filter((F.col("id").isNotNull()) & (F.size("ws") > 0))
    return w.select("id", F.md5(F.concat_ws(" ", "ws")).alias("sid"), "ws").dropDuplicates(["id", "sid"])


def similar_sets(classes: DataFrame, s: float = 0.8) -> DataFrame:
    """Pairs (a, b), a < b, of set ids with shared words / all words >= s; classes: sid (unique), ws. Exact and whole."""
    tokens = classes.select("sid", F.explode("ws").alias("w")).select("sid", F.xxhash64("w").alias("h"))
    df = stored(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")))
    hot = df.filter(F.col("df") * HOT_SHARE >= df.agg(F.sum("df")).scalar()).select("h")  # words of a third of all texts, say
    bit = F.pmod(F.col("h"), F.lit(128))
    one = F.lit(1).cast("long")
    per = skew_join(tokens, df, ["h"], hot).groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"),
        F.bit_xor(F.when(bit < 64, F.expr("shiftleft(1L, cast(pmod(h, 128) as int))")).otherwise(0)).alias("hi"),
        F.bit_xor(F.when(bit >= 64, F.expr("shiftleft(1L, cast(pmod(h, 128) - 64 as int))")).otherwise(0)).alias("lo"),
    )
    n = F.size("t")
    head = per.select("sid", "hi", "lo", n.alias("n"), "t", (n - F.ceil(n * s - 1e-9).cast("int") + 1).alias("p"))
    first = F.slice("t", F.lit(1), F.col("p"))
    more = F.slice("t", F.lit(1), F.col("p") + 1)
    alone = F.transform(F.filter(first, lambda x: (x["df"] > 1) & (x["df"] <= COMMON)), lambda x: x["h"])
    both = F.flatten(
        F.transform(F.filter(first, lambda x: x["df"] > COMMON), lambda x: F.transform(F.filter(more, lambda y: y["h"] != x["h"]), lambda y: F.xxhash64(F.least(x["h"], y["h"]), F.greatest(x["h"], y["h"]))))
    )
    short = F.transform(F.filter(first, lambda x: (x["df"] > COMMON) & (n < 2)), lambda x: x["h"])
    entries = stored(head.select("sid", "n", "hi", "lo", F.explode(F.array_distinct(F.concat(alone, both, short))).alias("k")))
    sizes = stored(entries.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    blocks = sizes.select("k", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    held = skew_join(entries, blocks, ["k"], sizes.filter(F.col("c") * HOT_SHARE >= sizes.agg(F.sum("c")).scalar()).select("k"))
    held = held.withColumn("b", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    spread = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("k", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "sid", "n", "hi", "lo")
    found = spread.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInPandas(_search(s), "a string, b string").distinct()
    wa, wb = classes.select(F.col("sid").alias("a"), F.col("ws").alias("wa")), classes.select(F.col("sid").alias("b"), F.col("ws").alias("wb"))
    both_ = F.size(F.array_intersect("wa", "wb"))
    return found.join(wa, "a").join(wb, "b").filter(both_ >= s * (F.size("wa") + F.size("wb") - both_) - 1e-9).select("a", "b")


def near_duplicates(rows: DataFrame, row_id: str, text: str, s: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id, sid; links has the pairs of different sets at least s alike, as a, b.

    Null ids, null texts and texts without a word belong to no set. Repeated rows count once. An empty table gives no
    members and no links. Copies are one set and are not paired with each other here.
    """
    m = stored(sets(rows, row_id, text))
    classes = m.groupBy("sid").agg(F.first("ws").alias("ws"))
    return m.select("id", "sid"), similar_sets(classes, s)


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs id_a < id_b of rows with alike or equal sets, distinct.

    Sets of many members are cut into blocks of about BLOCK, and pairs of blocks meet in tasks of their own, so that a set
    that a third of all rows have is spread as well.
    """
    counts = members.groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    blocks = stored(counts.select("sid", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"), "c"))
    hot = blocks.filter((F.col("c") > BLOCK) & (F.col("c") * HOT_SHARE >= blocks.agg(F.sum("c")).scalar())).select("sid")
    m = skew_join(members, blocks.select("sid", "nb"), ["sid"], hot).select("id", "sid", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("k"))
    nb = blocks.select("sid", "nb")
    met = links.join(nb.toDF("a", "na"), "a").join(nb.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    own = blocks.filter("c > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.col("nb").alias("na"), "nb")
    cells = met.unionByName(own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    cells = cells.withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("nb") - 1))).select("a", "b", "i", "j")
    both = cells.join(m.toDF("id_a", "a", "i"), ["a", "i"]).join(m.toDF("id_b", "b", "j"), ["b", "j"])
    return both.filter(F.col("id_a") != F.col("id_b")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
