"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for links ``a, b`` of one comparable type.

    Labels spread to neighbours and jump along their own labels until none changes, so
    rounds grow with the logarithm of the longest chain.  Each round is written; minima are
    taken before rows are shuffled, so a node with very many links is no burden.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("_m"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("root").alias("_next"))
        moved = materialise(spread.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_next", "_new")).alias("root"), (F.col("_old") != F.least("_new", F.coalesce("_next", "_new"))).alias("_moved")), "labels")
        labels = moved.select("node", "root")
        if moved.where("_moved").isEmpty():
            return labels
