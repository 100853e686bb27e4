"""Connected components of an edge table, as Spark jobs on kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.store import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that links reach.

    Each round points every node at the smallest label among itself and its neighbours, lets every label learn the
    smallest label that its members saw, and follows one pointer. Groups are aggregated before the shuffle, so a star with
    very many leaves is no hot group; the number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both)
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        met = keep(labels.join(near, "node").withColumn("seen", F.least("label", "seen")))
        if met.where("seen < label").isEmpty():
            return labels
        hooks = met.groupBy(F.col("label").alias("l")).agg(F.min("seen").alias("to"))
        hooked = met.join(hooks, F.col("label") == F.col("l")).select("node", F.least("seen", "to").alias("label"))
        hooked = keep(hooked)
        jump = hooked.select(F.col("node").alias("n2"), F.col("label").alias("next"))
        labels = keep(hooked.join(jump, F.col("label") == F.col("n2"), "left")
                      .select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
