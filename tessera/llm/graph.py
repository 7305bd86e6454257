"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, written


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links(a, b)``: ``comp`` is the smallest node of its component.

    Each round hooks every component onto its smallest neighbour, follows the hooks to their ends by doubling, and
    contracts the links; the links between different components at least halve the components they touch. All
    aggregates are minima, which combine before the shuffle; rounds end in written tables.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(ends.distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp")), "labels")
    while not edges.isEmpty():
        hooks = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("top"))
            nxt = written(hooks.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "hooks")
            moved = not nxt.where("moved").isEmpty()
            drop(hooks)
            hooks = nxt.select("node", "to")
            hooks._tessera_path = nxt._tessera_path
            if not moved:
                break
        relabelled = written(labels.join(hooks.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        end = lambda name: hooks.select(F.col("node").alias(name), F.col("to").alias(f"{name}2"))  # noqa: B023, E731
        moved_edges = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
        contracted = written(moved_edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(labels, edges, hooks)
        labels, edges = relabelled, contracted
    drop(edges)
    return labels
