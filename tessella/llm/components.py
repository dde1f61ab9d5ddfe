"""Connected components of an edge table by repeated contraction.

Every round each node points at its smallest neighbour (or itself); edges
and labels are rewritten through these pointers, loops and repeats are
dropped.  Where node numbers say nothing about the edges (hashes, as its
callers use) every round drops a constant share of the nodes that still have
edges; a path numbered from end to end takes a round for each node.  All state
lives in DataFrames; every round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` for every node with an edge to
    another node; ``root`` is the smallest node of its component.

    Self loops, repeated edges and rows with a null end are ignored; no
    edges give no rows.
    """
    e = cut(spark, edges.where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(spark, both.groupBy(F.col("a").alias("x"))
                    .agg(F.min("b").alias("m"))
                    .select("x", F.least("x", "m").alias("p")))
        if labels is None:
            labels = point.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            labels = (labels.join(point, labels.root == point.x, "left")
                      .select("node", F.coalesce("p", "root").alias("root")))
        labels = cut(spark, labels)
        pa = point.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        pb = point.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        e = cut(spark, e.join(pa, "a").join(pb, "b").where("pa <> pb")
                .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                .distinct())
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def union_find(size: int):
    """In-task union over array indices: returns ``(union, roots)``.

    ``union(a, b)`` takes index arrays; ``roots()`` gives the smallest index
    of every index's set.  Larger roots hook onto smaller ones, all pairs at
    a time.
    """
    import numpy as np

    parent = np.arange(size)

    def find(x):
        r = parent[x]
        while True:
            n = parent[r]
            if np.array_equal(n, r):
                return r
            r = n

    def union(a, b):
        while len(a):
            ra, rb = find(a), find(b)
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    return union, lambda: find(np.arange(size))
