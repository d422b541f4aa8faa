"""Connected components by alternating star contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._base import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the undirected graph `edges`; root is the smallest node reachable.

    Large-star hands every larger neighbour to the smallest one, small-star contracts what is left;
    both are aggregations and equi-joins, each round is written to the shared folder, and the
    number of rounds is logarithmic. Loops, repeated and null ends are left out: a node with no
    edge to another node gets no row. No links ever reach the driver, only a count and a checksum.
    """
    # Keep both ends in one pass: the larger first.
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = materialize(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
