"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.operators.scale import Stage


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b); the root is the smallest id that can be reached.

    Alternating star contraction: each round hangs the larger neighbours of a node, then its smaller ones,
    on the smallest one, until no edge changes.  Groups are only aggregated to a minimum, and minima go
    back by a join whose hot keys Spark can split; nothing is collected.  Rounds are written to the
    shared folder.  Self loops are ignored, nodes without edges do not appear.
    """
    stage = Stage(edges.sparkSession, "components")
    now = stage.save(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    before = None
    while True:
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(
            now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("child"), F.least("m", "u").alias("parent")).distinct()
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(least, "child").select(
            F.when(F.col("parent") == F.col("m"), F.col("child")).otherwise(F.col("parent")).alias("child"),
            F.col("m").alias("parent")).distinct()
        now = stage.save(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("child", "parent").cast("bigint")),
                       F.bit_xor(F.xxhash64("child", "parent"))).first()
        if seen == before:
            break
        before = seen
    stars = now.groupBy("child").agg(F.min("parent").alias("root"))
    return stars.select(F.col("child").alias("id"), "root").union(
        stars.select(F.col("root").alias("id"), "root").distinct())
