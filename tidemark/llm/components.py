"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and label, the smallest node of its component, for every node of the edges (a, b).

    Alternates two steps that keep components and bring every node closer to
    its smallest neighbour: each node hands its larger neighbours, then its
    smaller ones, to the smallest it knows. When nothing changes, every edge
    leads to a component's smallest node. Rounds grow with the logarithm of
    the longest path. Every round is written out, and its joins are between
    written tables, whose skewed keys Spark can split. Edges with a null end
    and loops join nothing.
    """
    ends = edges.filter("a is not null and b is not null and a != b")
    now = cut(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo")).distinct()
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.union(least.select("hi", "m")).distinct())
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
