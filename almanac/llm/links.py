"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (columns a, b): the smallest node that each one
    reaches. Every round takes the least label among the neighbours and then that label's own label,
    so paths shorten by more than half; rounds end when no label changes. All steps are joins and
    minima, so a node with very many links is never one group."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = materialize(step, "labels")
        labels = step.select("node", "label")
        if not step.where("label < old").limit(1).count():
            return labels
