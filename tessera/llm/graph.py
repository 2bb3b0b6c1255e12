"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) of every id that has a link.

    Each round takes the least label among the neighbours (an aggregation, combined on the map side, so a hub
    costs one row per task), then jumps to that label's own label, which halves the depth of the trees: the number
    of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other")))
    both = materialise(both.distinct(), "links")
    labels = materialise(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", "component", F.least("component", "m").alias("new"))
        up = step.select(F.col("id").alias("new"), F.col("new").alias("up"))
        step = materialise(step.join(up, "new", "left").select("id", F.col("component").alias("old"), F.least("new", "up").alias("component")), "labels")
        labels = step.select("id", "component")
        if step.filter("old <> component").limit(1).isEmpty():
            return labels
