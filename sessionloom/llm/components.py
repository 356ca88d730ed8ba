"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.text import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternates two kinds of star steps until nothing changes: neighbours above a node, then those
    below it, are linked to the smallest node around. The number of rounds grows with the
    logarithm of the component size. Every step aggregates before it shuffles, so a node with very
    many neighbours costs one partial row per task.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sums = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .where("a != b")
            .distinct()
        )
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == sums:
            break
        sums = state
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
