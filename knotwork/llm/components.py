"""Connected components by joins and aggregates; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of the links (``a``, ``b``): its component's smallest node.

    In each round a node takes the smallest label among its neighbours and itself, then the label of
    that label; labels are written to the shared folder, so lineage stays short.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = stash(step.join(jump, step["new"] == jump["at"]).select("node", F.col("label").alias("old"), F.least("new", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
