"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonedeck.llm.frames import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _pointed(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def connected_components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (bigint); root is the least node of the component.

    A round points every larger neighbour of a node at the least one (large star), then does the same among the
    smaller neighbours (small star).  Minima are pre-aggregated, so a hub costs each task one row; the joins that hand
    the minimum back are plain equi-joins of stored tables, which adaptive execution splits where a hub fills a
    partition.  Edges from a node to itself and repeated edges change nothing.
    """
    current = staged(_pointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), purpose)
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), purpose)
        large = _pointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = staged(large, purpose)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), purpose)
        small = large.join(least, "u")
        current = staged(_pointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))), purpose)
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
