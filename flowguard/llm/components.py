"""Connected components of a link table by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)``, the smallest node that each linked node reaches.

    Every round a node takes the smallest label among its neighbours, combined before the shuffle, and
    then the label of its label. Rounds are written tables; only the count of changes reaches the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "cc-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("_c"))
        low = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_low"))
        stepped = labels.join(low, "node").select("node", F.least("component", "_low").alias("_to"), F.col("component").alias("_was"))
        stepped = written(stepped, "cc-step")
        jump = stepped.select(F.col("node").alias("_to"), F.col("_to").alias("_next"))
        moved = written(stepped.join(jump, "_to", "left").select(
            "node", F.least(F.coalesce("_next", "_to"), F.col("_to")).alias("component"), "_was"), "cc-labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> _was").isEmpty():
            return labels
