"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomlake.llm import common


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """Per vertex of the edges (a long, b long): id, label, the smallest id that it reaches.

    Every round takes the smallest label among a vertex's neighbours and then its label's label,
    so the rounds grow with the logarithm of the longest path. Each round's labels are a table in
    the shared folder; edges and labels never leave the executors. Where a hub's edges meet its label,
    adaptive plans split the partition; what they bring is aggregated on the map side before it is
    dealt to their other ends. Edges with a null end connect nothing; loops and repeats change nothing.
    """
    both = common.saved(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = common.saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")), "labels")
    for _ in range(most):
        low = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        best = labels.join(low, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        above = labels.toDF("label", "over")
        step = common.saved(best.join(above, "label", "left").select("id", "old", F.least("label", F.coalesce("over", "label")).alias("label")), "labels")
        done = step.where("label <> old").isEmpty()
        common.dropped(labels)
        labels = step.select("id", "label")
        if done:
            common.dropped(both)
            return labels
    raise RuntimeError("the components did not settle")
