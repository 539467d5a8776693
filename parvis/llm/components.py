"""Connected components by stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parvis.llm.common import forget, stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node ties its larger (smaller and equal, if ``small``) neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = both.join(least, "a")
    if small:
        out = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    else:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its least node.

    Rows with a null end or with equal ends tell nothing and are left out. Large and
    small stars alternate until every node hangs on its root; each round is staged
    and removed when the next one is written.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        after = stage(_star(_star(edges, small=False), small=True))
        # stars are final: no node both hangs on another and has one hanging on it, and none hangs on two
        if after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            break
        forget(edges)
        edges = after
    roots = after.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stage(after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    forget(edges)
    forget(after)
    return found
