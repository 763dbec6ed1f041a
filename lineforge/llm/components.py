"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the least node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the least node around it; rounds grow with the logarithm of the size.
    Each is written to the shared folder.  A hub's edges are one skewed key of
    a join (which Spark splits), never one group.  Self-loops and repeated or
    reversed edges do no harm; an empty table has no nodes.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), name)
    before = None
    while True:
        both = e.union(e.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = (both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u <> v").distinct(), name)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
