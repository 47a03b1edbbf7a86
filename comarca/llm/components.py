"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import salted_join, stored


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's larger (or smaller) neighbours to the smallest node it knows."""
    edges = edges.filter("a != b")
    if large:
        edges = edges.union(edges.select("b", "a"))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct())
    centre = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree"))
    tied = salted_join(edges, centre, ["a"], "degree", edges.count(), "b")
    if large:
        return stored(tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    pairs = tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                          F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
    return stored(pairs.select("e.a", "e.b").filter("a != b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: the smallest node reachable.

    The edges are pairs of longs. Their number never grows, a node with many neighbours is
    dealt over several tasks, and every step is written out, so a lost executor costs a step.
    """
    edges = edges.select("a", "b")
    while True:
        edges = _starred(_starred(edges, True), False)
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        inner = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
        if twice.union(inner).isEmpty():  # every node points to one root, and no root points on
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
