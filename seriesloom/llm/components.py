"""Connected components of an edge table, as rounds of joins on the smaller side's distinct nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import stage
from seriesloom.session import unstage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the edges ``a``, ``b``: the smallest id that can be reached.

    Union-find by rounds: every edge is replaced by edges to the smallest neighbour (large star, then small star),
    until each node has one edge, to its root. The minimum of a node's neighbours is summed per task before
    the shuffle, and a node with many edges meets one row in the join, whose larger side Spark can split. The sums of a round
    tell whether the round is needed: the edges are done when no node has two smaller neighbours, or smaller and larger ones.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins shuffle both sides and a node with very many edges can be split
        down = F.count_if(F.col("b") < F.col("a"))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m"), down.alias("down"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "down", "n"))
        if least.where("down > 0 AND n > 1").isEmpty():
            unstage(least)
            break
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct())
        # each edge points down now: give a node's smaller neighbours its smallest one
        root = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = stage(small.unionAll(root.select("a", F.col("m").alias("b"))).distinct())
        for done in (least, large, root, now):
            unstage(done)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
