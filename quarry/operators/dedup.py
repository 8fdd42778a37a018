"""Duplicates, budgets, allocation and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def greedy_unlike(rows: DataFrame, group: str, item: str, tokens: str, order: str, alike: float = 0.92) -> DataFrame:
    """group, item, kept: best first, an item is dropped if it is `alike` to one kept before it in its group.

    Inherently sequential, so each group, the questions of one document, is one Arrow group.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        out = []
        p = p.sort_values([order, item], ascending=[False, True])
        for g, i, words in zip(p[group], p[item], p[tokens]):
            t = set(words)
            # sets of too different a size can't be alike
            dup = any(len(k) * alike <= len(t) <= len(k) / alike and len(t & k) / len(t | k) >= alike for k in kept) if t else False
            if not dup and t:
                kept.append(t)
            out.append((g, i, not dup))
        return pd.DataFrame(out, columns=[group, item, "kept"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in (group, item)}
    return rows.select(group, item, tokens, order).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {item} {kind[item]}, kept boolean")


def allocate(counts: DataFrame, key: str, n: str, budget: int) -> DataFrame:
    """key, n, alloc: the budget split in proportion to n by largest remainder, never above n; a budget of the total or more keeps all.

    One pass gives every remainder its unit; the place in the order of remainders comes from a range-partitioned sort.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"))
    c = counts.withColumn("total", total.scalar()).withColumn("quota", F.lit(float(budget)) * F.col(n) / F.greatest(F.col("total"), F.lit(1)))
    c = c.withColumn("base", F.when(F.lit(budget) >= F.col("total"), F.col(n)).otherwise(F.least(F.col(n), F.floor("quota")))).withColumn("frac", F.round(F.col("quota") - F.floor("quota"), 9))
    spare = c.agg((F.least(F.lit(budget), F.max("total")) - F.sum("base")).alias("spare"))
    room = c.filter(F.col("base") < F.col(n))
    taken = room.orderBy(F.desc("frac"), F.desc(n), F.desc(key)).limit(int(spare.first().spare or 0)).select(key, F.lit(1).alias("one"))
    return c.join(taken, key, "left").select(key, n, (F.col("base") + F.coalesce("one", F.lit(0))).cast("long").alias("alloc"))


def hash_share(value: Column) -> Column:
    """A number from 0 to 1 by the first 60 bits of a value's SHA-256."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("double") / F.lit(float(16**15 - 1))


# Pairs, fallback and target factors of each kind of document, and the cap on pairs.
BUDGETS = {"ISO_STANDARD": (6.0, 2.0, 1.2, 400), "TEXTBOOK": (8.0, 2.0, 1.5, 800), "REPORT": (5.0, 1.5, 1.0, 400), "UNKNOWN": (4.0, 1.5, 0.8, 400)}


def document_budget(rows: DataFrame, kind: str = "doc_type", facts: str = "n_facts", pages: str = "n_pages", cap: int = 64) -> DataFrame:
    """Budgets of each document by the product of the logarithms of its facts and pages; halves round to even, then limits apply."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *v) for k, v in BUDGETS.items()], "__k string, pk double, fk double, tk double, hi int"))
    known = F.when(F.col(kind).isin(*BUDGETS), F.col(kind)).otherwise("UNKNOWN")
    signal = F.log2(F.col(facts) + F.lit(1.0)) * F.log2(F.col(pages) + F.lit(1.0))
    r = rows.withColumn("__k", known).join(table, "__k").drop("__k").withColumn("signal", F.round(signal, 6))

    def clamp(x: Column, lo: int, hi: Column) -> Column:
        return F.greatest(F.lit(lo), F.least(F.bround(x, 0).cast("int"), hi))

    return r.withColumns({"pairs": clamp(F.col("pk") * F.col("signal"), 24, F.col("hi")), "fallback": clamp(F.col("fk") * F.col("signal"), 8, F.lit(128)), "target": clamp(F.col("tk") * F.col("signal"), 4, F.lit(cap))}).drop("pk", "fk", "tk", "hi")
