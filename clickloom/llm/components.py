"""Connected components of an edge table by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import hot_join
from clickloom.state import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    Every round takes the smallest label among neighbours and then the label of that label, so chains
    halve. Labels are written to the shared folder each round. Neighbours are only ever reduced to a
    minimum; a node with very many edges is dealt out.
    """
    both = settle(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "cc_edges",
    )
    degree = settle(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("least")), "cc_degree")
    labels = settle(degree.select("node", F.least("node", "least").alias("label"), "degree"), "cc_labels")
    while True:
        seen = hot_join(both.withColumnRenamed("a", "node"), labels, ["node"], "degree", ["node", "b"])
        near = seen.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        stepped = settle(
            labels.join(near, "node").select("node", F.least("label", "near").alias("label"), "degree", F.col("label").alias("old")), "cc_step"
        )
        uses = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("uses"))
        roots = stepped.select(F.col("node").alias("label"), F.col("label").alias("root")).join(uses, "label")
        labels = settle(
            hot_join(stepped, roots, ["label"], "uses", ["node"], "left")
            .select("node", F.coalesce("root", "label").alias("label"), "degree", "old"),
            "cc_labels",
        )
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label", "degree")
        if not moved:
            return labels.select("node", "label")
