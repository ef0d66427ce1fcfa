"""Connected components of a large graph, by alternating star contractions.

Every round hangs each node's larger neighbours on the smallest node it knows,
then each node's smaller neighbours; a long path halves with every round.  All
steps are aggregations and joins that adaptive execution may split, so that a
node with very many edges is no bottleneck, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.io import keep


def connected(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node.

    Edges with a null end and loops are ignored.  ``limit`` rounds (enough for
    any graph that fits a cluster) without an end raise an error.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "components")
    mark = None
    for _ in range(limit):
        both = now.select("node", "to").unionByName(now.select(F.col("to").alias("node"), F.col("node").alias("to")))
        lowest = both.groupBy("node").agg(F.min("to").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(lowest, "node").where("to > node and to <> low").select(F.col("to").alias("node"), F.col("low").alias("to")).distinct()
        lowest = large.groupBy("node").agg(F.min("to").alias("low"))
        small = large.join(lowest, "node")
        small = small.select("node", F.col("low").alias("to")).unionByName(small.select(F.col("to").alias("node"), F.col("low").alias("to"))).where("node <> to").distinct()
        now = keep(small, "components")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select("node", F.col("to").alias("component")).unionByName(now.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle within {limit} rounds")
