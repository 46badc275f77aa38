"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, group) for every end of an edge (src, dst, both long): ``group``
    is the smallest node of the component. Each round every node takes the
    smallest label among its neighbours and then the label of that label, until
    nothing changes; rounds are checkpointed. No edges give no rows. The joins hash
    the side with one row for each node."""
    edges = edges.checkpoint()
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("group")).checkpoint()
    while True:
        near = both.join(labels.hint("shuffle_hash"), both["dst"] == labels["node"]).groupBy("src").agg(F.min("group").alias("near"))
        taken = labels.join(near.hint("shuffle_hash"), labels["node"] == near["src"]) \
            .select("node", F.col("group").alias("old"), F.least("group", "near").alias("taken"))
        jump = labels.select(F.col("node").alias("taken"), F.col("group").alias("further"))
        new = taken.join(jump.hint("shuffle_hash"), "taken").select("node", "old", F.least("taken", "further").alias("group")).checkpoint()
        if new.where("group != old").isEmpty():
            return new.select("node", "group")
        labels = new.select("node", "group")
