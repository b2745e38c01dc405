"""Connected components by least label and pointer jumping, as joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in `edges` (a, b): label is the least node that it reaches.

    A round takes each node's least label among itself, its neighbours and its label's label; rounds end
    when nothing changes, after about the logarithm of the longest path. Each round is written to the
    shared folder. A hub's minimum is pre-aggregated by task and its join is split by Spark."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter(F.col("a") != F.col("b")).distinct())
    labels = held = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = labels.join(near, "node").join(up, "label").select("node", F.least("label", "near", "up").alias("new"), "label")
        done = stored(step)
        dropped(held)
        labels, held, changed = done.select("node", F.col("new").alias("label")), done, done.filter(F.col("new") != F.col("label")).limit(1).count()
        if not changed:
            dropped(both)
            return labels
