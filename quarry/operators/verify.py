"""Verification over score columns. A model's score is any function of (premise, hypothesis); token support stands in here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import share_held_set, tokens


def support(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's distinct tokens that the premise holds."""
    return share_held_set(tokens(hypothesis), F.array_distinct(tokens(premise)))


def scored(pairs: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], known: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """premise, hypothesis, score of each distinct pair: `known` scores are kept, the others computed once, in Arrow batches.

    Pairs with a null side are left out.
    """
    todo = pairs.select("premise", "hypothesis").filter("premise is not null and hypothesis is not null").distinct()
    if known is not None:
        todo = todo.join(known, ["premise", "hypothesis"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = list(zip(p.premise, p.hypothesis))
            got = [s for i in range(0, len(rows), batch) for s in score(rows[i : i + batch])]
            yield p.assign(score=got)

    new = todo.mapInPandas(run, "premise string, hypothesis string, score double")
    return new if known is None else new.unionByName(known.select("premise", "hypothesis", "score"))


def leave_one_out(groups: DataFrame, items: str = "items", answer: str = "answer") -> DataFrame:
    """Inputs of the necessity test: every column, left_out (from 0) and premise, the other items joined. Fewer than two items give none."""
    idx = F.sequence(F.lit(0), F.size(items) - 1)
    rows = groups.filter(F.size(items) >= 2).withColumn("left_out", F.explode(idx))
    return rows.withColumn("premise", F.array_join(F.filter(items, lambda x, i: i != F.col("left_out")), " "))


def necessity(scored_rows: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, n, n_necessary, score: the share of items without which the answer is no longer supported."""
    need = F.count_if(F.col("score") < threshold)
    return scored_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), need.alias("n_necessary"), F.round(need / F.count(F.lit(1)), 3).alias("necessity"))
