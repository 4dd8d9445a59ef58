"""Connected components of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecorisk.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node that can be reached.

    Each round every node takes the smallest label around it, hands it to the node that its old label names, and jumps
    to its label's label, so that rounds grow with the logarithm of the longest path. Each round is written, and the
    driver sees only how many labels changed. Null ends are ignored, repeated links and links to oneself do no harm.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = materialize(known.select("a", "b").union(known.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("around"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "around").alias("least"))
        told = near.select("node", "least").union(near.select(F.col("component").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("least"))
        told = materialize(told)
        jumped = told.join(told.select(F.col("node").alias("least"), F.col("least").alias("further")), "least")
        after = materialize(jumped.select("node", F.least("least", "further").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").count()
        labels = after
        if not changed:
            return labels
