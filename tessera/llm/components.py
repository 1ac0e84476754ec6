"""Connected components of a link table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (columns a, b: longs); label is the smallest node.

    Every node starts with the smallest of itself and its neighbours. In each round all
    nodes of a label move together to the smallest label that any of them has for a
    neighbour, and then to that label's own label, until none moves. Minima are taken
    before the shuffle, and the joins are between written tables, so that Spark can
    split them where a node or label has many rows, or broadcast a small side.
    """
    one_way = links.select("a", "b").where("a <> b")
    edges = materialize(one_way.union(one_way.select("b", "a")).toDF("node", "other"), "links")
    labels = edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        own = labels.select("node", "label")
        near = edges.join(theirs, "other").join(own, "node").groupBy("label").agg(F.min("theirs").alias("target"))
        moves = materialize(near.where("target < label"), "moves")
        if moves.isEmpty():
            return labels
        # A target may move itself in this round, always to a smaller label.
        onward = moves.select(F.col("label").alias("target"), F.col("target").alias("onward"))
        jumped = moves.join(onward, "target", "left").select("label", F.coalesce("onward", "target").alias("target"))
        labels = materialize(own.join(jumped, "label", "left").select("node", F.coalesce("target", "label").alias("label")), "labels")
