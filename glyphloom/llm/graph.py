"""Connected components over an edge table, for any number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (columns a, b), component being the smallest id that can be reached.

    Each round every node takes the smallest id among itself and its neighbours as parent, parents are
    followed once more, and edges are redrawn between parents; an edge that has become a loop goes. The
    graph shrinks by more than half a round. Both tables are written each round, so nothing is recomputed
    if executors go, those of earlier rounds are deleted, and no node's neighbours are ever gathered: minima are taken with partial sums.
    Loops and repeated edges are fine; an empty table gives an empty one. Nulls are left out.
    """
    live = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialise(live, "cc-edges")
    labels = materialise(live.select("a").union(live.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component")), "cc-labels")
    whole, live = live, live.where("a <> b")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        old, parent = (whole, labels), materialise(parent, "cc-parents")
        over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        root = materialise(parent.join(over, "up").select("node", "top"), "cc-roots")
        labels = materialise(labels.join(root, labels["component"] == root["node"], "left").select("id", F.coalesce("top", "component").alias("component")), "cc-labels")
        x = live.join(root, live["a"] == root["node"]).select(F.col("top").alias("a"), "b")
        x = x.join(root, x["b"] == root["node"]).select("a", F.col("top").alias("b"))
        whole = live = materialise(x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        discard(*old, parent, root)
    discard(whole)
    return labels
