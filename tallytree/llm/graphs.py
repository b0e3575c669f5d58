"""Connected components of a large graph by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallytree.session import parts_for, pin

#: Links that a file holds before there are more files than two for every core.
LINKS_PER_FILE = 50_000


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Each step joins edges with one minimum per node, so a node with very many links is a
    skewed equi-join and never a group in one task. Every step is a written table; the rounds end
    as soon as all links are stars, which further steps would not change. The number
    of edges never grows. An isolated node has no row. Nodes may be of any type with an order.
    Links of a node to itself and null ends do not count. A path of 2 ** ``max_rounds`` nodes
    would be needed to reach the guard; it raises.
    """
    stars = pin(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    parts = parts_for(stars.sparkSession, stars.count(), LINKS_PER_FILE)
    for _ in range(max_rounds):
        # Large star: the larger neighbours of a node meet its smallest neighbour.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            stars.select(F.col("b").alias("a"), F.col("a").alias("far")).join(low, "a")
            .select(F.col("far").alias("a"), F.col("m").alias("b"))
        )
        large = pin(large.filter("a <> b").distinct(), "large-star", parts=parts)
        # Small star: a node and its smaller neighbours meet the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        stars = pin(small.filter("a <> b").distinct(), "small-star", parts=parts)
        ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
            stars.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        between = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1 AND up > 0")
        if not between.agg(F.count(F.lit(1))).first()[0]:
            roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
