"""Connected components of a table of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for each end of the edges (a, b).

    Each round takes the smallest label of the neighbours and then the label's label, so labels
    cross a path in a logarithmic number of rounds. A round's labels are written to the shared
    folder; only the number of changed labels reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = staged(lower.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
