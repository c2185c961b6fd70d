"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.staging import written


def component_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node of ``edges`` (src, dst longs).

    Each round gives every node its smallest neighbour (or itself) and contracts the edges over that; every
    node but a local minimum goes, so at least half of the nodes left do. No group of rows is gathered:
    a hub is a key of one aggregate and the large side of a join that Spark may split. Self-loops and
    repeated edges do no harm; without edges there are no rows.
    """
    edges = written(edges.select("src", "dst"), "cc-edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "cc-labels")
    left = edges.where(F.col("src") != F.col("dst"))
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = written(both.groupBy("src").agg(F.min("dst").alias("near")).select(F.col("src").alias("at"), F.least("src", "near").alias("to")), "cc-parent")
        moved = labels.join(parent, labels["label"] == parent["at"], "left")
        labels = written(moved.select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        a = parent.select(F.col("at").alias("src"), F.col("to").alias("a"))
        b = parent.select(F.col("at").alias("dst"), F.col("to").alias("b"))
        shrunk = left.join(a, "src").join(b, "dst").where(F.col("a") != F.col("b"))
        left = written(shrunk.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "cc-edges")
    return labels
