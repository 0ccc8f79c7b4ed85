"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of each component of the edges (a, b).

    Each round hooks every node's root under the smallest root seen across its edges and
    then jumps pointers, so the number of rounds grows with the logarithm of the longest
    chain.  A node of very many edges is pre-aggregated before each shuffle.  Only one
    number (edges left) per round reaches the driver.  Edges with a null end are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    left = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parents = None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    root = stored(nodes.distinct().withColumn("root", F.col("node")), "nodes")
    while not left.isEmpty():
        # smallest neighbour of every root that still has an edge to a smaller one
        parents = stored(left.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent")), "parents")
        for _ in range(2):
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            parents = parents.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"))
        parents = stored(parents, "parents")
        root = stored(root.join(parents, F.col("root") == F.col("child"), "left")
                      .select("node", F.coalesce("parent", "root").alias("root")), "roots")
        pa, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        moved = (left.join(pa, "a", "left").join(pb, "b", "left")
                 .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y"))
        left = stored(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return root
