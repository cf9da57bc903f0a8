"""Connected components of a links table by alternating large and small stars (Kiveris et al., 2014).

Every step is a grouped minimum and a join on a node, so a hub is pre-aggregated or split, never collected.
Each round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def star_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(a, b) links of comparable nodes -> (node, root), root the least node reachable; only nodes with links.

    Links from a node to itself and null ends are ignored.
    """
    edges = materialize(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour points to the least of the neighbourhood
        large = both.join(least, both["a"] == least["k"]).where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b")).distinct()
        # small star: a node and its smaller neighbours point to the least of these
        floor = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(floor, large["a"] == floor["k"]).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b"))
        edges = materialize(small.unionByName(floor.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"),
                           F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
