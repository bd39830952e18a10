"""Connected components by alternating large-star and small-star steps, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import delete, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, no nulls) to ``node``, ``component``: the smallest node that can be reached.

    Only nodes of at least one edge to another node come out. Each step links nodes to the smallest
    neighbour: aggregation finds it (partial sums first), a join brings it to the neighbours, so a
    node with very many neighbours is never gathered in one place. Rounds go on until every node is linked to
    one other, which is linked to none; they grow with the logarithm of the number of nodes. Each round is written, the one before deleted.
    """
    spark = edges.sparkSession
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        rows = now.count()
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges", rows)
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(under, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.union(under.select("u", F.col("m").alias("v"))).distinct(), "edges", rows)
        for old in (now, large):
            delete(spark, old)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether edges (from larger to smaller) are stars: no node has two smaller ones, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("n"), "v").union(edges.select("v", F.lit(None).cast("long")))
    sides = ends.groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("all"), F.count("v").alias("up"))
    return sides.where("low <> high OR (up > 0 AND up < all)").isEmpty()
