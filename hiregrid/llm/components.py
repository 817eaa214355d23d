"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrid.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of bigint nodes to (node, component), the component being the smallest node reachable.

    Every round each node takes the least label among its neighbours' and its own, and then the label of that label, which
    halves the way to the end of long chains. Minima are combined before shuffles, so a node with very many links is no
    burden; rounds write their labels under ``spark.checkpoint.dir``. A null end makes no link. Without links no rows.
    """
    both = materialize(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links"
    )
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "component", F.least("component", "other").alias("next")
        )
        far = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = materialize(taken.join(far, "next").select(
            "node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved")
        ), "labels")
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
