"""Connected components of flows that share a source or a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.sources.workspace import checkpoint


def shared_components(flows: DataFrame, key: str = "flow", source: str = "source", sink: str = "sink") -> DataFrame:
    """key and component, the least key that a chain of shared sources and sinks reaches.

    Each round gives every flow the least label among those of its source and its sink, then jumps: a flow takes over
    what the flow that names its label holds. Rounds grow with the logarithm of the longest chain in usual graphs, and
    lineage is cut each time.
    """
    labels = checkpoint(flows.select(key, source, sink, F.col(key).alias("component")))
    while True:
        new = labels
        for side in (source, sink):
            low = new.groupBy(side).agg(F.min("component").alias("_low"))
            new = new.join(low.withColumnRenamed(side, "_side"), F.col(side) == F.col("_side"), "left")
            new = new.withColumn("component", F.coalesce("_low", "component")).drop("_low", "_side")
        jump = new.select(F.col(key).alias("_k"), F.col("component").alias("_c"))
        new = new.join(jump, F.col("component") == F.col("_k"), "left").withColumn("component", F.least("component", "_c")).drop("_k", "_c")
        old = labels.select(F.col(key).alias("_k"), F.col("component").alias("_c"))
        new = checkpoint(new)
        if new.join(old, F.col(key) == F.col("_k")).where("component <> _c").isEmpty():
            return new.select(key, "component")
        labels = new
