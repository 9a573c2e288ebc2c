"""Connected components of an edge table, without collecting edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import discard, store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label, changed) for all ends of edges(a, b): label is the smallest node that can be reached. A stored table.

    Rounds of taking the smallest label beside a node and then that label's own label, until nothing
    changes: about log2 of the longest shortest path. A round is a join and a partial aggregate.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = store(near, "near")
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = store(step.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("changed")), "step")
        discard(near, labels)
        labels = step
        if not step.filter("changed").limit(1).count():
            discard(both)
            return labels
