"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one HOT_SHARE-th of all rows on, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 64


def hot_keys(rows: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold at least a `share`-th of the rows of `rows`: at most `share` rows.

    Counts are combined on the map side first. Null keys count as a key. An empty input has no hot key.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("__n") > 1) & (F.col("__n") * share >= total)).select(*keys)


def skew_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of many `rows` with `facts` (one row per key).

    `hot` lists the hot keys of `rows` (see hot_keys: at most HOT_SHARE rows). Their facts are broadcast, so the hot
    rows are never shuffled; all other rows meet their facts by an ordinary equi-join. Null keys never match.
    Clashing column names outside `keys` are the caller's to rename; the result has rows' columns, then facts' others.
    """
    hot = F.broadcast(hot.select(*keys).distinct())
    few = F.broadcast(facts.join(hot, keys, "left_semi"))
    cold = rows.join(hot, keys, "left_anti").join(facts, keys)
    return cold.unionByName(rows.join(few, keys))


#: Bits of a filter for each key, and of a filter at most: 64 MB when sent to every executor.
BITS_A_KEY, MOST_BITS = 16, 1 << 29
_PART = 32768  # bits of one bitmap


def key_filter(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among `wanted`; no row whose key is wanted is lost, and few others stay.

    The hashes of the wanted keys are sent out as bits, never the keys: a filter of BITS_A_KEY bits a key and MOST_BITS in
    all, so it is bounded however many keys there are (with more than MOST_BITS / BITS_A_KEY keys more rows stay). `wanted`
    is read twice, so it should be a written table. Null keys are never kept.
    """
    n = wanted.count()
    size = _PART
    while size < min(MOST_BITS, n * BITS_A_KEY):
        size *= 2
    h = F.pmod(F.xxhash64(*keys), F.lit(size))
    known = wanted.select(h.alias("__h"))
    bits = known.groupBy(F.expr(f"__h div {_PART}").alias("__p")).agg(F.expr(f"bitmap_construct_agg(__h % {_PART})").alias("__m"))
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    held = rows.filter(there).withColumn("__h", h).withColumn("__p", F.expr(f"__h div {_PART}")).join(F.broadcast(bits), "__p")
    byte = F.expr(f"cast(conv(hex(substring(__m, cast((__h % {_PART}) div 8 as int) + 1, 1)), 16, 10) as int)")
    return held.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(__h % 8 as int))")) != 0).select(*rows.columns)
