"""Filling containers of fixed capacity: a configuration linear program over the histogram of lengths.

A configuration says how many items of each length share a container. The program (use as few configurations as cover all
items) is solved by multiplicative weights: what is short of its share of cover gains weight, what is ahead loses it, and
configurations are priced by dynamic programming over the capacity. One table of the program prices, for every length, the
best configuration that holds it. Each table also gives a dual solution, so a lower bound on the number of containers.
The solution is rounded down to whole containers; what is left of the histogram is priced again, in whole containers, the
longest items first. Only what no configuration fills (near) to the brim is filled greedily. All of that sees the histogram
only, at most one entry per token count; the items then find their container by their rank in their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored

#: Folder of the public tokenizers' files, and the one used; both are parameters.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Rounds in which the cover is raised to the whole, and how fast weights follow the cover.
ROUNDS, STEP = 3, 4.0
#: By how much a longer item is worth more a token, so that short ones are left for the end; too little to waste a token.
LONGER = 1e-4
#: Part of the capacity that a container priced from the rest may leave empty, at most.
SLACK = 0.02
#: Items of one length that are ranked by one task, about.
RANKED = 500_000


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str):
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with (Path(folder) / vocabulary).open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of each document with a text, over the whole text; repeated ids count once (their longest text)."""
    ids = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for p in batches:
            yield pd.DataFrame({"doc_id": p.iloc[:, 0], "tokens": [len(encode(t)) for t in p.iloc[:, 1]]})

    use = documents.select(doc_id, text).filter(documents[doc_id].isNotNull() & documents[text].isNotNull())
    return use.mapInPandas(run, f"doc_id {ids}, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def prices(lengths: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the greatest weight of a multiset of lengths within it, and a length to take (-1: waste 1)."""
    dp = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        v = dp[c - lengths[: upto[c]]] + weight[: upto[c]]
        k = int(v.argmax())
        if v[k] > dp[c - 1] + 1e-15:
            dp[c], take[c] = v[k], k
        else:
            dp[c] = dp[c - 1]
    return dp, take


def _read(lengths: np.ndarray, take: np.ndarray, room: int) -> dict[int, int]:
    """Index of length to count of the best multiset within the room."""
    got: dict[int, int] = {}
    while room >= lengths[0]:
        k = int(take[room])
        if k < 0:
            room -= 1
            continue
        got[k] = got.get(k, 0) + 1
        room -= int(lengths[k])
    return got


def best_configuration(lengths: np.ndarray, weight: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of length to count: the heaviest multiset of lengths within the capacity, by dynamic programming."""
    return _read(lengths, prices(lengths, weight, capacity)[1], capacity)


def _fair(lengths: np.ndarray, capacity: int) -> np.ndarray:
    share = lengths / capacity
    return share * (1 + LONGER * share)


def program(lengths: np.ndarray, h: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple, float], float]:
    """A fractional solution, {configuration: containers}, that covers every length, and the best lower bound seen.

    In each round the cover of all lengths is raised by an equal share. Of one table of prices all configurations are used
    that put no length far ahead; then weights follow the cover, and lengths ahead of their share have none.
    """
    cover, uses, bound = np.zeros(len(h)), {}, 0.0
    price = _fair(lengths, capacity)
    for t in range(1, rounds + 1):
        target, most = t / rounds, (t + 1) / rounds
        while len(need := np.flatnonzero(cover < target - 1e-9)[::-1]):
            ix = np.flatnonzero(cover < most)
            w = price[ix] * np.exp(step * (target - cover[ix]))
            dp, take = prices(lengths[ix], w, capacity)
            bound = max(bound, float((h[ix] * w).sum() / dp[capacity]))
            placed = 0
            for l in need.tolist():
                if cover[l] >= target - 1e-9:
                    continue
                a = {int(ix[k]): n for k, n in _read(lengths[ix], take, capacity - int(lengths[l])).items()}
                a[l] = a.get(l, 0) + 1
                mine = (target - cover[l]) * h[l] / a[l]
                room = min((most - cover[k]) * h[k] / n for k, n in a.items())
                if room < 0.3 * mine and placed:
                    continue
                x = min(max(room, 0.3 * mine), mine)
                key = tuple(sorted(a.items()))
                uses[key] = uses.get(key, 0.0) + x
                for k, n in a.items():
                    cover[k] += n * x / h[k]
                placed += 1
    return uses, bound


def _whole(uses: dict[tuple, float], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """The solution rounded down, the most used configurations first; takes its items from `left`."""
    out = []
    for key, x in sorted(uses.items(), key=lambda u: -u[1]):
        times = min(int(x + 1e-9), *(int(left[k] // n) for k, n in key))
        if times > 0:
            out.append((dict(key), times))
            for k, n in key:
                left[k] -= n * times
    return out


def _priced(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole containers for what is left, priced by tables over it; the longest first. Takes its items from `left`.

    A configuration is only used while it wastes little; the waste allowed grows up to SLACK when nothing else is found.
    """
    out, waste = [], 0
    price = _fair(lengths, capacity)
    while left.any():
        ix = np.flatnonzero(left)
        ls, w = lengths[ix], price[ix]
        dp, _ = prices(ls, w, capacity)
        placed = 0
        for j in range(len(ix) - 1, -1, -1):
            while left[ix[j]]:
                room, a, free = capacity - int(ls[j]), {j: 1}, left[ix].copy()
                free[j] -= 1
                while room >= ls[0]:
                    top = int(np.searchsorted(ls, room, side="right"))
                    v = np.where(free[:top] > 0, dp[room - ls[:top]] + w[:top], -1.0)
                    k = int(v.argmax())
                    if v[k] < 0:
                        break
                    a[k] = a.get(k, 0) + 1
                    free[k] -= 1
                    room -= int(ls[k])
                if room > waste:
                    break
                times = min(int(left[ix[k]]) // n for k, n in a.items())
                out.append(({int(ix[k]): n for k, n in a.items()}, times))
                placed += times
                for k, n in a.items():
                    left[ix[k]] -= n * times
        if not placed:
            if waste > capacity * SLACK:
                break
            waste = max(1, waste * 2)
    return out


def _greedy(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills containers with all that is left, the longest first, each gap by the longest that fits."""
    left, out = left.copy(), []
    while left.any():
        here = np.flatnonzero(left)
        room, a, top = capacity, {}, len(here)
        while top and room >= lengths[here[0]]:
            top = min(top, int(np.searchsorted(lengths[here], room, side="right")))
            if not top:
                break
            k = int(here[top - 1])
            a[k] = min(int(left[k]), room // int(lengths[k]))
            room -= a[k] * int(lengths[k])
            top -= 1
        times = min(int(left[k] // n) for k, n in a.items())
        out.append((a, times))
        for k, n in a.items():
            left[k] -= n * times
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[list[tuple[str, dict[int, int], int]], float]:
    """(stage, length to count, containers) that hold exactly the items of the histogram of lengths 1 to capacity, and the bound.

    stage: `whole` from the program's solution rounded down, `priced` from tables over the rest, `greedy` what remains.
    """
    lengths = np.array(sorted(l for l, n in histogram.items() if n > 0 and 0 < l <= capacity), dtype=np.int64)
    if not len(lengths):
        return [], 0.0
    h = np.array([histogram[int(l)] for l in lengths], dtype=np.int64)
    uses, bound = program(lengths, h, capacity, rounds, step)
    left = h.copy()
    parts = [("whole", _whole(uses, left)), ("priced", _priced(lengths, left, capacity)), ("greedy", _greedy(lengths, left, capacity))]
    return [(stage, {int(lengths[k]): n for k, n in a.items()}, t) for stage, found in parts for a, t in found], bound


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[dict[int, int], int]]:
    """(length to count, number of containers) of `solve`."""
    return [(a, t) for _, a, t in solve(histogram, capacity, rounds, step)[0]]


PLAN = "capacity int, len long, lo long, hi long, per long, base long, times long, stage string, bound double"


def plan(histograms: DataFrame, tasks: int) -> DataFrame:
    """PLAN: where the items of each rank in their length go, for each capacity; histograms: capacity, len, n.

    Each capacity's program is solved in one of `tasks` tasks; its histogram has at most `capacity` rows.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        found, bound = solve(dict(zip(p.len.tolist(), p.n.tolist())), int(key[0]))
        used: dict[int, int] = {}
        out, base = [], 0
        for stage, a, times in found:
            for l, n in a.items():
                r = used.get(l, 0)
                out.append((key[0], l, r, r + n * times, n, base, times, stage, bound))
                used[l] = r + n * times
            base += times
        return pd.DataFrame(out, columns=["capacity", "len", "lo", "hi", "per", "base", "times", "stage", "bound"])

    return histograms.repartition(tasks, "capacity").groupBy("capacity").applyInPandas(run, PLAN)


def items(counts: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, doc_id, piece, token_start, len: documents within a capacity whole, longer ones in pieces of it and a rest."""
    sizes = F.explode(F.array(*(F.lit(int(c)) for c in capacities))) if capacities else F.lit(1)
    rows = counts.filter("tokens > 0" if capacities else "false").select("doc_id", "tokens", sizes.alias("capacity"))
    cuts = F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)
    rows = rows.select("*", F.explode(cuts).alias("piece"))
    start = (F.col("piece") * F.col("capacity")).cast("long")
    return rows.select("capacity", "doc_id", "piece", start.alias("token_start"), F.least(F.col("capacity").cast("long"), F.col("tokens") - start).alias("len"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0, within each capacity and len. A length of any number of items is ranked by many tasks.

    Ranks are given within buckets of a length; the buckets' sizes, a small table, give the offsets. Lengths have as many
    buckets as they need for about RANKED rows in each.
    """
    held = rows.withColumn("b0", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 20)).cast("int"))
    counts = rows.groupBy("capacity", "len").agg(F.ceil(F.count(F.lit(1)) / RANKED).cast("int").alias("nb"))
    held = held.join(counts, ["capacity", "len"]).withColumn("bucket", F.col("b0") % F.col("nb"))
    sizes = held.groupBy("capacity", "len", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("offset", F.sum("c").over(Window.partitionBy("capacity", "len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = held.withColumn("r", F.row_number().over(Window.partitionBy("capacity", "len", "bucket").orderBy("doc_id", "piece")) - 1)
    return own.join(before.select("capacity", "len", "bucket", F.coalesce("offset", F.lit(0)).alias("offset")), ["capacity", "len", "bucket"]).withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "bucket", "b0", "nb")


def planned(counts: DataFrame, capacities: list[int]) -> tuple[DataFrame, DataFrame]:
    """items() of the capacities, and their plan as a written table."""
    rows = items(counts, capacities)
    return rows, stored(plan(rows.groupBy("capacity", "len").agg(F.count(F.lit(1)).alias("n")), min(1000, 8 * len(capacities) + 1)))


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """capacity, doc_id, piece, token_start, tokens, container. A length has a few ranges for each configuration that holds it."""
    ranges = plan.groupBy("capacity", "len").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "per", "base"))).alias("ranges"))
    mine = F.element_at(F.filter("ranges", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    at = ranked(rows).join(ranges, ["capacity", "len"]).withColumn("x", mine)
    return at.select("capacity", "doc_id", "piece", "token_start", F.col("len").alias("tokens"), (F.col("x.base") + F.floor((F.col("rank") - F.col("x.lo")) / F.col("x.per"))).cast("long").alias("container"))


def pack(counts: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, token_start, tokens, container: every token of every document in one container of the capacity.

    Documents of no token need no room and get no container. An empty table gives no containers.
    """
    return placed(*planned(counts, [capacity])).drop("capacity")


def pack_all(documents: DataFrame, sizes: DataFrame, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """pack() for each row of sizes (pack_id, capacity), with pack_id first; and the plan of each capacity.

    Documents are tokenised once, equal capacities are solved once; null or non-positive sizes and no sizes give no rows.
    """
    use = sizes.filter("pack_id is not null and capacity > 0").select("pack_id", F.col("capacity").cast("int").alias("capacity")).distinct()
    rows, where = planned(stored(token_counts(documents, folder=folder)), sorted(r.capacity for r in use.select("capacity").distinct().collect()))
    return use.join(placed(rows, where), "capacity").drop("capacity"), use.join(where, "capacity")
