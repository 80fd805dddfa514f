"""Connected components as Spark joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of ``edges`` (a, b) with the least vertex of its component.

    Each round takes the least label among neighbours, then follows labels one step, so long chains close quickly. A round
    is written to the shared folder; a vertex with very many neighbours is pre-aggregated.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("w"), F.col("v")).alias("c")), "labels")
    while True:
        near = (both.join(labels, both["w"] == labels["v"]).groupBy("u").agg(F.min("c").alias("m")))
        hooked = labels.join(near, labels["v"] == near["u"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        root = labels.select(F.col("v").alias("r"), F.col("c").alias("rc"))
        moved = stored(hooked.join(root, hooked["c"] == root["r"]).select("v", "old", F.least("c", "rc").alias("c")), "labels")
        labels = moved.select("v", "c")
        if moved.where("old <> c").isEmpty():
            return labels
