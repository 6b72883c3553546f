"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a long, b long); component is the smallest node reachable.

    Each round hooks a node's larger neighbours to its smallest one, then its smaller ones; the
    rows never grow beyond the edges and rounds grow with the logarithm of a component. Every
    round is checkpointed, so a lost executor costs one round. Null ends and loops are no edges.
    An empty table gives an empty result.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = cut_lineage(now), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        now = cut_lineage(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
