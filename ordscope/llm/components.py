"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordscope.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; component is its smallest node.

    Each round lowers a node's label to the smallest label next to it and then to
    the label of that label, so a chain of n nodes takes about log n rounds. A round
    is two equi-joins and two map-side combined aggregates, written to the shared
    folder; only the number of changed labels comes to the driver. Null ends and
    self-loops are ignored, repeated edges do no harm, and an empty table gives an
    empty result.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    clean = clean.select("a", "b").distinct()
    both = materialise(clean.union(clean.select(F.col("b"), F.col("a"))), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
        lowered = near.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(lowered, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "seen").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        moved = lower.join(jump, "label").select(
            "node", "before", F.least("label", "further").alias("component")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("before")).limit(1).count() == 0:
            return labels
