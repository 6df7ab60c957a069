"""Connected components of an edge table: smallest label, with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round links every tree's root to the smallest root that any edge of the tree reaches, then
    halves paths, so the rounds grow with the logarithm of the longest chain. All state is written
    to ``scratch`` between rounds; nothing but two counts per round reaches the driver. Aggregations
    by node combine on the map side, so a node with very many edges is not gathered in one task.
    """
    edges = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = scratch.table(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "parents")
    while True:
        # Pointer jumping until every node knows its root.
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.table(parent.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            moved = jumped.where("moved").limit(1).count()
            parent = jumped.drop("moved")
            if not moved:
                break
        # Edges between different roots, as edges of the roots.
        left = parent.select(F.col("node").alias("a"), F.col("p").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        open_ = edges.join(left, "a").join(right, "b").where("ra <> rb")
        open_ = scratch.table(open_.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if not open_.limit(1).count():
            return parent.select("node", F.col("p").alias("component"))
        hooks = open_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hook"))
        parent = parent.join(hooks, "node", "left").select("node", F.coalesce("hook", "p").alias("p"))
        parent = scratch.table(parent, "parents")
        edges = open_
