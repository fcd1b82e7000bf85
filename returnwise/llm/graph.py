"""Connected components by joins: minimum labels with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.session import materialise


def connected_components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so paths shorten geometrically. Rounds go on until no label changes; a graph that has
    not settled after ``most_rounds`` is an error, never a partial answer. Every round is written
    to the shared folder, so a lost executor costs a re-read. An empty table gives an empty one.
    """
    edges = materialise(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    )
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("label")
    ))
    for _ in range(most_rounds):
        nearest = (
            edges.join(labels, edges.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        pulled = labels.join(nearest, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "seen").alias("label")
        )
        jumped = materialise(
            pulled.join(
                labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"
            ).select("node", "was", F.least("label", "next").alias("label"))
        )
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
