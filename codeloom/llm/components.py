"""Connected components of an edge table that may be too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b: long); component is the least node that links reach.

    Each round takes the least label among a node's neighbours and then the label of its label, so that a path of n nodes
    takes about log n rounds. Every round is written to the shared folder; only a count of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), like="edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), like="labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        nearer = cut(labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now")), like="labels")
        up = nearer.select(F.col("node").alias("now"), F.col("now").alias("component"))
        moved = cut(nearer.join(up, "now").select("node", "was", "component"), like="labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
