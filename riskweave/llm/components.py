"""Connected components of a table of links, by large-star and small-star steps over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: those above a node (large), or the node and those below it (small)."""
    if large:
        ends = links.union(links.select("b", "a")).toDF("node", "other")
    else:
        ends = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = ends.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    hung = ends.join(least, "node")
    if large:
        hung = hung.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        hung = hung.select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return hung.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Each turn at least halves the distance to the smallest node in most graphs; it ends when a turn changes
    nothing. Nothing but two sums reaches the driver.
    """
    links = store(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    state = None
    while True:
        links = store(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    below = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return below.union(links.select("b", "b").distinct())
