"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans.session import materialize, materialize_counted


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, get linked to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with a link, where component is the smallest
    node of its component.  Links are contracted until they are stars around it;
    groups are never collected, only minima per node, and every step is written
    under the shared checkpoint folder."""
    edges = materialize(links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    while True:
        # count and check sum come with the write: a step is one job
        edges, now = materialize_counted(_small_star(_large_star(edges)), "cc", sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == before or not now["rows"]:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select("component", "component").distinct().toDF("node", "component"))


def near_labels(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with a link: the smallest node within two links.
    Nodes with one label are in one component, but a component may have several labels;
    a group linked to one of its members has one.  No step is repeated or written."""
    one = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    spread = both.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", "m").unionByName(least)
    return spread.groupBy(F.col("u").alias("node")).agg(F.min("m").alias("component"))
