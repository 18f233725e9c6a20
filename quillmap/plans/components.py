"""Connected components of an edge list, by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.plans.storage import apart, keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; label is the smallest node of its component.

    Each round takes the least label among the neighbours and then the label of that label, so a chain of n nodes needs
    about log n rounds. Every round is written to the shared folder; nothing is collected. Edges with a null end are
    ignored, repeated edges and loops change nothing, an empty list gives an empty table.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = keep(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    labels = apart(labels)
    while True:
        told = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("heard"))
        heard = labels.join(told, labels.node == told.v, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("near"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        after = keep(heard.join(target, heard.near == target.t, "left").select("node", "was", F.least("near", F.coalesce("jump", "near")).alias("label")), "labels")
        labels = apart(after.select("node", "label"))
        if after.where("was <> label").limit(1).count() == 0:
            return labels
