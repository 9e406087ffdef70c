"""Connected components by contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import forget, keep


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the undirected links ``a, b``; the root is one of
    the component's nodes.

    Each round gives every node its smallest neighbour if that is smaller, follows
    those pointers to their ends, and replaces the links' ends by what they point to.
    At least every second node of a component that is left has a smaller neighbour or
    is one, so the links are gone after a logarithmic number of rounds. Rounds are
    written down; nothing but counts reaches the driver. A node with very many links
    is an aggregate's key (combined before the shuffle) or a join key with one row on
    the other side (which the planner may split).
    """
    edges = keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct(),
        "links",
    )
    pointers = None
    while not edges.isEmpty():
        # The larger end of a link points to the smallest node beside it.
        step = keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hook")
        while True:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            joined = step.join(up, "root", "left")
            if joined.where("up IS NOT NULL").isEmpty():
                break
            shorter = keep(joined.select("node", F.coalesce("up", "root").alias("root")), "jump")
            forget(step)
            step = shorter

        moved = edges
        for end in ("a", "b"):
            to = step.select(F.col("node").alias(end), F.col("root").alias("to"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        smaller = keep(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a < b")
            .distinct(),
            "links",
        )
        if pointers is None:
            pointers = step
        else:
            # Nodes that point to a node which has moved on follow it.
            on = step.select(F.col("node").alias("root"), F.col("root").alias("on"))
            followed = pointers.join(on, "root", "left").select(
                "node", F.coalesce("on", "root").alias("root")
            )
            known = pointers.select("node")
            merged = keep(followed.union(step.join(known, "node", "left_anti")), "pointers")
            forget(pointers)
            forget(step)
            pointers = merged
        forget(edges)
        edges = smaller
    if pointers is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pointers.select(F.col("root").alias("node"), "root").distinct()
    return pointers.union(roots.join(pointers.select("node"), "node", "left_anti"))
