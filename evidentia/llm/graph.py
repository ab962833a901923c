"""Connected components by label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` to ``v, c``: each node that has an edge and the smallest node it reaches.

    Every round takes the smallest label among neighbours and then the label of that label, so labels run down
    chains in about log(length) rounds. Neighbours are aggregated before the shuffle, so hubs are no hot tasks.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).withColumn("c", F.least("v", "c")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        met = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = materialize(met.join(jump, "c", "left").select("v", F.least("c", F.coalesce("j", "c")).alias("c"), "old"), "labels")
        changed = new.filter("c <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            return labels.select("v", "c")
