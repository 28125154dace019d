"""Connected components of an edge table by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import Workspace


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long); component is its smallest node.

    Each round every node hooks onto its smallest neighbour, pointers are doubled, and edges
    are rewritten between the new roots; edges shrink by at least half of their nodes a round,
    so there are logarithmically many rounds. Minima are combined before the shuffle, so
    a node with very many edges doesn't gather in one task. No edges: no rows. Self-loops give
    a component of their own.
    """
    edges = space.keep(edges.select("src", "dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    jumps: list[DataFrame] = []
    while True:
        live = edges.filter("src <> dst")
        if not live.limit(1).count():
            break
        both = live.union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("up"))
        again = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = space.keep(parent.join(again, "up").select("node", "top"))
        left = jump.select(F.col("node").alias("src"), F.col("top").alias("a"))
        right = jump.select(F.col("node").alias("dst"), F.col("top").alias("b"))
        moved = live.join(left, "src").join(right, "dst").filter("a <> b")
        moved = moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        jumps.append(jump)
        edges = space.keep(moved)
    labels = nodes.withColumn("component", F.col("node"))
    for jump in jumps:  # where each node's root went, round by round
        labels = labels.join(jump.select(F.col("node").alias("component"), "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
