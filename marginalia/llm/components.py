"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node and label for every node of ``edges`` (a, b; bigint): label is the least node of its component.

    A round gives every node the least label of its neighbours, then the label of its label, so paths shrink by
    doubling. Every round is written to the shared folder. Nodes without edges are not in the result; a hub's rows are
    counted by partial aggregates and its joins are ones that Spark splits when skewed."""
    pairs = edges.filter("a <> b").select("a", "b")
    both = cut_lineage(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = cut_lineage(least.join(up, "label").select("node", "old", F.least("label", "higher").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
