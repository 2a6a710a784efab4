"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> id, component (the least id reachable); ids on edges only. Each round takes the least label around,
    then that label's own label; nothing but a count of changes comes to the driver."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"), F.lit(True).alias("moved")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component")
        least = labels.select("id", "component").union(seen).groupBy("id").agg(F.min("component").alias("near"))
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        moved = least.join(up, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("component"))
        old = labels.select("id", F.col("component").alias("old"))
        fresh = settle(moved.join(old, "id").select("id", "component", (F.col("component") < F.col("old")).alias("moved")), "labels")
        forget(labels)
        labels = fresh
        if labels.filter("moved").isEmpty():
            forget(both)
            return labels
