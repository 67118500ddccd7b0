"""Connected components of a table of links, by written tables and without any list of a component's members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node in ``links`` (a, b: long).

    Each pass gives a node the least label around it and then its label's label, so that long chains shrink by
    halves. Sums are made before shuffles, so one huge component costs no more than its links.
    """
    both = stage(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(around, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        lower = stage(lower, "labels-near")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = stage(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")),
            "labels",
        )
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
