"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, label): label is the smallest node of the component.

    Each round every node takes the smallest label among its neighbours' and then its label's label; rounds are
    logarithmic in a component's width. Labels are written to the shared folder every round; only the number
    of changed labels comes to the driver. An empty edge table gives no rows."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "components-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "components-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parent = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = stored(hooked.join(parent, "label", "left").select("node", "old", F.least("label", "above").alias("label")), "components-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
