"""Connected components by repeated contraction of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.tables import Stages


def linked_labels(edges: DataFrame, stages: Stages) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(a, b)``; the label is one node of the component.

    That one node has no row of its own: whoever joins the table takes a node without a row as
    its own label.

    Every node with a smaller neighbour takes the smallest as its parent, parents are followed to
    their roots by doubling, and edges between roots are the next round's. Only narrow rows move,
    minima combine before the shuffle, and nothing is collected. Empty edges give an empty table.
    """
    edges = stages.put(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    labels = None
    while not edges.isEmpty():
        roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = stages.put(roots)
        while True:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
            step = stages.put(
                roots.join(up, "parent", "left").select(
                    "node", F.coalesce("higher", "parent").alias("parent"), F.col("higher").isNotNull().alias("moved")
                )
            )
            moved = not step.where("moved").isEmpty()
            stages.drop(roots)
            roots = step
            if not moved:
                break
        roots = roots.select("node", "parent")
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        ends = (
            edges.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        )
        contracted = stages.put(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        merged = roots.select("node", F.col("parent").alias("label"))
        if labels is not None:
            higher = roots.select(F.col("node").alias("label"), F.col("parent").alias("root"))
            known = labels.join(higher, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            merged = known.union(merged)
        done, labels = labels, stages.put(merged)
        stages.drop(edges)
        if done is not None:
            stages.drop(done)
        edges = contracted
    stages.drop(edges)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``, those that are labels included."""
    labels = linked_labels(edges, stages)
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
