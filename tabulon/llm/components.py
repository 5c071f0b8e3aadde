"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import staged


def components(edges: DataFrame) -> DataFrame:
    """`a`, `b` (long) → `node`, `label`: the smallest node that each node is connected with.

    Each round a node takes the smallest label among its neighbours, then the label of that label, so that long chains
    shrink fast. Rounds are written to the shared folder; nothing but a count of changes reaches the driver.
    """
    both = staged(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", per_core=1)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels", per_core=1)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_next"))
        jump = labels.select(F.col("node").alias("_next"), F.col("label").alias("_far"))
        step = step.join(jump, "_next").select("node", F.col("label").alias("_old"), F.least("_next", "_far").alias("label"))
        step = staged(step, "labels", per_core=1)
        labels = step.select("node", "label")
        if step.where("label <> _old").isEmpty():
            return labels
