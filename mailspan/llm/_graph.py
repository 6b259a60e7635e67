"""Connected components by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspan.llm._common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for the nodes of `edges` (src, dst).

    Each round every node takes the smallest label around it and then its label's label, so that the number of rounds
    grows with the logarithm of the longest path. Rounds are written to the shared folder; only a count reaches the driver.
    """
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = written(edges.filter("src <> dst").select(ways.alias("e")).select("e.src", "e.dst").distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        own = labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("top"), F.col("component").alias("over"))
        moved = written(own.join(up, own["c"] == up["top"], "left").select("node", F.coalesce(F.least("c", "over"), F.col("c")).alias("component"), "old"), "labels")
        if moved.filter("component <> old").limit(1).count() == 0:
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, component) after more `links` (src, dst): only what connects different components is worked on."""
    top = labels.select(F.col("node"), F.col("component"))
    named = links.select("src", "dst")
    for side in ("src", "dst"):
        named = named.join(top.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    over = components(named.distinct()).select(F.col("node").alias("component"), F.col("component").alias("over"))
    ends = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(top, "node", "left_anti").withColumn("component", F.col("node"))
    return written(top.union(ends).join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")), "labels")
