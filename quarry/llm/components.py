"""Connected components of an edge list, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, label: the least node that its links reach. Every round is written, none is collected."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct().toDF("node", "next"), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("label").alias("seen")), "next")
        least = near.groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "seen").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = materialise(step.join(jump, "to", "left").select("node", F.col("label").alias("was"), F.least("to", F.coalesce("beyond", "to")).alias("label")), "labels")
        if new.filter("was != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
