"""Connected components by least labels with pointer jumping; every round is a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) give node and component (the least node it reaches). Nodes without links aren't in the result.

    In each round a node takes the least label among its own, its neighbours' and that of the node its label
    names, so labels spread over doubling distances. Rows stay in the number of nodes and links.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = staged(both, "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("far"))
        made = lower.join(jump.hint("merge"), "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("component"))
        made = staged(made, "labels")
        if made.where("was != component").isEmpty():
            return made.select("node", "component")
        labels = made.select("node", "component")
