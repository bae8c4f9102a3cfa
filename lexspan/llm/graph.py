"""Connected components of a link table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; the root is a node of the same component.

    Each round gives every node the smallest label among its neighbours and then follows
    labels once more, so the number of rounds grows with the logarithm of the diameter.
    Minima are combined before the shuffle, so a hub with many links is no hot spot.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = staged(both.union(both.select("other", "node")).distinct())
    labels = staged(edges.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        reached = (
            edges.join(labels.withColumnsRenamed({"node": "other", "root": "seen"}), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        lower = staged(labels.join(reached, "node").select("node", "root", F.least("root", "seen").alias("low")))
        hop = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        after = staged(lower.join(hop, "low").select("node", F.least("low", "lowest").alias("new"), "root"))
        labels = after.select("node", F.col("new").alias("root"))
        if after.where("new <> root").isEmpty():
            return labels
