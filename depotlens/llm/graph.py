"""Connected components of a link table, by label propagation with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has a link.

    Each round a node takes the least label among itself and its neighbours, then that label's own label.
    Minima combine before the exchange, so a node with very many links costs a row a task.
    Labels are stored after every round; only a changed-row count comes to the driver.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = stored(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = stored(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = edges.join(of_other, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = stored(step.join(jump, "to", "left").select("node", "old", F.least("to", F.coalesce("far", "to")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
