"""Connected components of a link table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut


def components(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, group: the least node that links lead to, by stars pointed at ever smaller nodes; nodes: node; links: a, b.

    Alternates large and small stars until nothing changes; each round is a few equi-joins and is written to the
    shared folder. No component is gathered in one place. A node without links is its own group; self-links are ignored.
    The rounds needed grow with the logarithm of the longest path; where `rounds` is given and doesn't suffice, it raises.
    """
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    mark = None
    for done in count():
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        down = large.filter("x <> y").distinct().select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = cut(small.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("g")), "node", "left").groupBy("node").agg(F.coalesce(F.min("g"), F.col("node")).alias("group"))
