"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then each v is its component's root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or (up = 1 and top = 1)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node, root for each node that has an edge to another; root is its component's least node. Edges with a null end or from a node to itself are left out; none give an empty result.

    A round takes minima of each node's neighbours (combined before they shuffle) and joins them back, so a hub's edges
    never meet in one task; the number of rounds grows with the logarithm of the size. Each round's edges are checkpointed.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        now = cut(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("the components have not settled")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
