"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node.

    Each round takes the smallest label among the neighbours and then the label of that
    label; it ends when no label changes.  Every round is written to the shared folder.
    """
    both = materialize(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(edges.select("b", "a"))
        .distinct(),
        "links",
    )
    labels = materialize(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels"
    )
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        hooked = (
            both.join(known, "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
            .join(labels, "node")
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialize(
            hooked.join(jump, "label", "left").select(
                "node", "old", F.coalesce("further", "label").alias("label")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
