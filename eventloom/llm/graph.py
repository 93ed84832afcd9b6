"""Connected components of an edge table by rounds of hooking, pointer jumping and contraction.

Only joins and grouped minima: hot nodes are combined before they move, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges(a, b) can reach.

    Each round, every node points at its smallest neighbour (or itself), pointers are followed to their end, and
    edges are drawn anew between the ends; a round at least halves the nodes that still have edges. Self-loops
    make a node without neighbours; edges with a null end are ignored. No edges give no rows.
    """
    rest = cut_lineage(edges.where("a is not null and b is not null").select("a", "b").distinct())
    labels = cut_lineage(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("root", F.col("node")))
    rest = rest.where("a <> b")
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        parent = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")))
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = cut_lineage(parent.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        ends = parent.select(F.col("node").alias("root"), F.col("parent").alias("end"))
        labels = cut_lineage(labels.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        for side in ("a", "b"):
            rest = rest.join(parent.select(F.col("node").alias(side), F.col("parent").alias(f"new_{side}")), side)
        rest = cut_lineage(rest.where("new_a <> new_b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).distinct())
    return labels
