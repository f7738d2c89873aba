"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copy_rows, hot_keys, materialize, split_rows

#: Parts over which the nodes of one label are dealt.
SPREAD = 256


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, label): for every node of the edges (a, b) the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours and then
    that label's own label, so paths halve; a round's labels are written, which
    ends the lineage.  Neighbours' labels are reduced by a partial aggregation,
    so a hub costs each task one row; a hub's label reaches its edges, and a label's
    own label the nodes that have it, over parts.  Runs until nothing changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-both")
    hot = hot_keys(both, "b", "cc-hot").withColumnRenamed("b", "v")
    both = materialize(split_rows(both.withColumnRenamed("b", "v"), hot, "v", "a"), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("w")).agg(F.least(F.min("a"), F.min("v")).alias("label")).withColumnRenamed("w", "v"), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(copy_rows(labels, hot, "v"), ["v", "part"]).groupBy(F.col("a").alias("w")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels["v"] == near["w"]).select("v", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        step = step.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("further"))
        jump = step.select("to", "part").distinct().join(jump, "to")
        moved = materialize(step.join(jump, ["to", "part"]).select("v", "was", F.least("to", "further").alias("label")), "cc-labels")
        labels = moved.select("v", "label")
        if moved.filter(F.col("was") != F.col("label")).isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
