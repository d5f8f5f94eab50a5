"""Connected components of an edge table, by least labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.session import Rounds, pin


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over ``edges`` (a, b); nodes without edges are absent.

    Each round every node learns the least label among its neighbours, and so does the node that its own label
    names, so that whole clusters join and not only their border. Then each node follows its label's label, which
    halves the depth. On chains with names in any order the rounds grow with the logarithm of the length. Only
    counts come to the driver; each round is written as a table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pin(both.where("a <> b").distinct())
    rounds = Rounds(edges.sparkSession, "components")
    labels = rounds.write(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")
    ))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("_node")).agg(F.min("label").alias("_near"))
        )
        told = labels.join(near, F.col("node") == F.col("_node")).select(
            "node", "label", F.least("label", "_near").alias("_least")
        )
        # The node itself, with the label that it had, and the node that its label names.
        pairs = F.explode(F.array(
            F.struct("node", F.col("label").alias("_old"), "_least"),
            F.struct(F.col("label").alias("node"), F.lit(None).alias("_old"), "_least"),
        ))
        lower = told.select(pairs.alias("p")).select("p.*").groupBy("node").agg(
            F.max("_old").alias("_old"), F.min("_least").alias("label")
        )
        jump = lower.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        after = rounds.write(lower.join(jump, F.col("label") == F.col("_at"), "left").select(
            "node", "_old", F.least("label", F.coalesce("_next", "label")).alias("label")
        ))
        changed = not after.where("label <> _old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels
