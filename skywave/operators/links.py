"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywave.sources.tables import stored

#: Edges that one task of a round takes.
EDGES_A_TASK = 200_000
#: Parts over which the edges of one node are spread in a join.
HUB_PARTS = 16


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b), both long; component is the smallest node reachable.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path,
    every round is aggregation and join on the edges alone, and nothing but two sums reaches the driver.
    No edges give an empty result.
    """

    def star(e: DataFrame, large: bool, parts: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v <= u")
        # the edges of a hub are spread over parts; a node's least neighbour has a row for each part that the node uses
        both = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).cast("int"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts")).select(F.col("u").alias("lu"), F.least("m", "u").alias("m"), "parts")
        spread = least.withColumn("lpart", F.explode(F.expr(f"filter(sequence(0, {HUB_PARTS - 1}), i -> getbit(parts, i) = 1)")))
        j = both.join(spread, (both.u == spread.lu) & (both.part == spread.lpart))
        moved = j.where("v > u") if large else j.where("v <> m")
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("lu").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct().coalesce(parts)

    def digest(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        return r[0], r[1]

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = digest(e)
    while seen[0]:
        parts = 1 + seen[0] // EDGES_A_TASK
        e = stored(star(star(e, True, parts), False, parts), label)
        now = digest(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
