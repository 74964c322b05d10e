"""Connected components of an edge table, without gathering edges or labels in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sweep


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: root is the smallest node that can be reached.

    Large and small stars in turn: each node links its larger neighbours, then its smaller ones, to the least of them.
    Every round halves the distances, is cut from its lineage, and aggregates before it shuffles a frequent node.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Now every edge runs from a node to a smaller one: a node's smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small)
        del both, low, large, small
        sweep(links.sparkSession)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))


def _settled(links: DataFrame) -> bool:
    """Whether the edges ``u, v`` are stars: every u has one v, and no v is a u."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()
