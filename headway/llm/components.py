"""Connected components of an edge table, by falling labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headway.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b); the label is the smallest id that can be reached.

    Each round takes the smallest label among the neighbours (combined before the shuffle) and then the
    label of that label, so the rounds grow with the logarithm of the longest path. Every round is
    written to the shared folder, and the one before is removed.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b"))
                         .select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("far"))
        before, labels = labels, materialise(lower.join(jump, F.col("label") == F.col("at"), "left").select(
            "id", "old", F.least("label", "far").alias("label")), "labels")
        discard(before)
        if labels.where("old <> label").isEmpty():
            discard(both)
            return labels.select("id", "label")
