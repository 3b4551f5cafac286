"""Connected components of a link table, by contraction.

Every round each component hooks onto its smallest neighbour, pointers are shortened, and links are
rewritten to the new components; links within one go. Nothing is collected; a component with very
many links is aggregated before shuffles and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.session import stored

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for all nodes of ``links`` (columns a and b, longs)."""
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent")).withColumnRenamed("a", "child")
        parents = stored(parents, "parents")
        for _ in range(JUMPS):
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            parents = stored(parents.join(up, "parent").select("child", F.col("above").alias("parent")), "parents")
        of = lambda name: parents.select(F.col("child").alias(name), F.col("parent").alias(f"{name}_up"))
        labels = labels.join(of("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label"))
        labels = stored(labels, "labels")
        edges = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        edges = stored(edges.where("a <> b").distinct(), "links")
    return labels
