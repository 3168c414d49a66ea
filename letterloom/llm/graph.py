"""Connected components by contraction, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import checkpoints, cut


def pairs(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, the larger node as ``a``."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the undirected edges ``a, b``: the least node of its component.

    Each round takes the least node among a node and its neighbours and then the least node of that one, and joins what has the same into
    one node. So a round leaves at most about half of the nodes, whatever the paths' lengths and the order of nodes in them, and the edges
    left get fewer with them. All steps are joins and partial aggregations; the driver sees one number a round. Every round is cut by
    checkpoints (:func:`cut`), so that lost executors cost one round. Both sides of the joins grow with the input, so none is left to be
    broadcast, which would bring it to the driver.
    """
    checkpoints(edges.sparkSession)
    left, labels = cut(pairs(edges)), None
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("low")))
        # Cut here and below, so that Spark may split the next join where many nodes have one label or neighbour.
        up = low.select(F.col("node").alias("n"), F.col("low").alias("up"))
        up = cut(low.join(up.hint("merge"), low.low == up.n).select(F.col("node").alias("n"), "up"))
        half = cut(left.join(up.hint("merge"), left.a == up.n).select(F.col("up").alias("a"), "b"))
        left = cut(pairs(half.join(up.hint("merge"), half.b == up.n).select("a", F.col("up").alias("b"))))
        if labels is None:
            labels = up.select(F.col("n").alias("node"), F.col("up").alias("label"))
        else:
            labels = cut(labels.join(up.hint("merge"), labels.label == up.n, "left").select("node", F.coalesce("up", "label").alias("label")))
        if not left.limit(1).count():
            return labels
