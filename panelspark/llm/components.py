"""Connected components by label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """edges (a, b) of one type -> (node, label): label is the smallest node of the component; nodes without an edge
    do not appear. Null ends and self-links are ignored; no edges give no rows.

    Each round every node takes the smallest label among its neighbours' and its label takes it too, then labels are
    followed one step (log rounds). Messages are reduced by min before the shuffle, and both sides of each join are
    written tables, so a node with very many links is split by the adaptive skew join.
    """
    once = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = ws.save(once, "edges")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        near = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        seen = both.join(far, "b").join(near, "a").where("lb < la")
        told = seen.select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("label")).groupBy("node").agg(F.min("label").alias("told"))
        step = labels.join(told, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        step = ws.save(step, "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = ws.save(step.join(jump, "label").select("node", F.col("up").alias("label"), "was"), "labels")
        if labels.where("label <> was").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
