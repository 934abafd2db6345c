"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b): root is the same for all of a component, and one of them.

    Each round sends a vertex to its least neighbour, follows that once more, and renames the ends of the edges; loops
    go. A component of n vertices is one vertex after O(log n) rounds. State is cut from its lineage in every round.
    """
    both = edges.where("a <> b").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = None
    while True:
        hop = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        again = hop.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        hop = cut(hop.join(again, F.col("p") == F.col("_v")).select("v", F.least("p", "_p").alias("p")))
        if root is None:
            root = hop.select("v", F.col("p").alias("root"))
        else:
            root = cut(root.join(hop.select(F.col("v").alias("_v"), F.col("p").alias("_p")), F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_p", "root").alias("root")))
        left, right = hop.select(F.col("v").alias("a"), F.col("p").alias("pa")), hop.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        both = cut(both.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        if both.isEmpty():
            return root
