"""Connected components of an edge table: least labels spread along edges, and labels jump to their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import broadcast_checked
from ragtables.session import materialize

#: Neighbours above which the label of a node is sent to all tasks instead of dealing its edges to one.
MANY_NEIGHBOURS = 1_024


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for all ends of the edges; a component is named by its least node.

    In each round a node takes the least label among itself and its neighbours, then the label of the node that names it,
    until nothing changes. Minima are pre-aggregated, and labels of nodes with more than ``MANY_NEIGHBOURS`` neighbours,
    of which there are fewer than edges by that factor, reach the edges by a checked broadcast, so no node is a single
    task; every round is written to the shared folder. Null ends and loops take no part.
    """
    one = edges.filter(F.col(left) != F.col(right)).select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    hubs = materialize(both.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > MANY_NEIGHBOURS).select("v"), "hubs")
    split = hubs.limit(1).count() > 0
    if split:
        hubs = broadcast_checked(hubs, "hubs", row_bytes=48)
        both = materialize(both.join(hubs.withColumn("hub", F.lit(True)), "v", "left").withColumn("hub", F.coalesce("hub", F.lit(False))), "edges")
    labels = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")), "labels")
    while True:
        names = labels.select(F.col("u").alias("v"), F.col("c").alias("of"))
        if split:
            named = both.filter("not hub").join(names, "v").unionByName(
                both.filter("hub").join(broadcast_checked(names.join(hubs, "v"), "names", row_bytes=64), "v"))
        else:
            named = both.join(names, "v")
        near = named.groupBy("u").agg(F.min("of").alias("near"))
        stepped = labels.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "near").alias("v"))
        jumped = stepped.join(names, "v").select("u", F.col("of").alias("c"), (F.col("of") != F.col("was")).alias("moved"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("u", "c")
        if not jumped.filter("moved").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
