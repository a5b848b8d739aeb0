"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriweave.llm.common import settled

MAX_ROUNDS = 60


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("m", F.least("u", "least"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node of the edges (u, v: long).

    Each round is two aggregations by node over edges that are kept distinct, so no task
    holds the neighbours of a node. Rounds are written to the shared folder.
    """
    current = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "component-edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        seen = _least_neighbour(large)
        small = (
            seen.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(seen.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = settled(small, "component-edges")
        after = sign(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
