"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b: bigint); label is the component's least vertex.

    Each round every vertex takes the least label next to it, then the label of its label, so
    the number of rounds grows with the logarithm of the longest path. Minima combine before
    the shuffle and joins may be split by adaptive execution, so a vertex with very many links
    makes no large group. Labels are written and reread each round. No edges: no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = low.select(F.col("v").alias("label"), F.col("label").alias("jump"))
        step = cut(low.join(up, "label", "left").select("v", "old", F.least("label", "jump").alias("label")), "labels")
        labels = step.select("v", "label")
        if step.where("old != label").isEmpty():
            return labels
