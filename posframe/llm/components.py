"""Connected components of an edge table by alternating large-star and small-star rounds.

Minimums are partial sums before the shuffle and are written before they are joined back, so that adaptive execution can
split the edges of a hub. Each round's edges are a written table: a lost executor repeats a part of one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), long -> (node, root) for every node that has an edge to another, the root itself left out.

    The root is the smallest node of the component. Loops and repeated edges do no harm; no edges, no rows.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = cut(small, "small-star")
        # settled: every node that has a root has one, and is no root itself
        sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or up = 1 and root = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")
