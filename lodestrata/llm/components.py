"""Connected components of an edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.joins import skew_join
from lodestrata.runtime import materialize


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge touches; root is the least node.

    Each round hooks every node to its least neighbour, halves the paths twice
    and contracts the edges, so the number of nodes at least halves: the rounds
    grow with the logarithm of the longest component.  Nothing is collected;
    each round is written to the shared folder.  Null ends are ignored.
    """
    live = (
        edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
        .dropna()
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    live = materialize(live, "cc-edges")
    mapping = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node"))
    for _ in range(max_rounds):
        live = live.where("a <> b")
        if live.isEmpty():
            break
        # Edges are stored as (smaller, larger), so the least neighbour below a node is a minimum over one side.
        parent = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        parent = materialize(parent, "cc-parent")
        low = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        high = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = (
            live.join(low, "a", "left")
            .join(high, "b", "left")
            .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        live = materialize(moved, "cc-edges")
        step = parent.select(F.col("node").alias("root"), "up")
        # A large component's root is a hot key.
        mapping = skew_join(mapping, step, "root", ["node"], how="left").select("node", F.coalesce("up", "root").alias("root"))
        mapping = materialize(mapping, "cc-map")
    else:
        raise RuntimeError("components did not converge")
    return mapping
