"""Connected components of an edge table that never leaves the executors.

Defined cases: an edge from a node to itself makes it a component of its own;
repeated edges and both directions count once; ends must not be null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.tables import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the smallest node of the component of each node that has an edge.

    Every round hooks each label to its smallest neighbour, follows two pointers
    and contracts the edges, until no edge joins different labels.  Rounds grow
    with the logarithm of the longest chain in practice; aggregates combine
    before they shuffle, so a hub is no single large group.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = staged(both.filter("a <> b").distinct(), "edges")
    labels = staged(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        hook = staged(hook, "hooks")
        for _ in range(2):
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
        hook = staged(hook, "hooks")
        to = hook.select(F.col("x").alias("label"), "p")
        labels = staged(labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        ends = lambda c: hook.select(F.col("x").alias(c), F.col("p").alias(f"p{c}"))
        moved = left.join(ends("a"), "a").join(ends("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        left = staged(moved.filter("a <> b").distinct(), "edges")
    return labels
