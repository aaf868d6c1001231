"""Centroid clustering of vectors in integers, with expressions of the JVM alone.

A component x becomes the integer floor(scale * x), x as double.  The centroids of a round stand in the plan as literal
arrays: ``zip_with`` and ``aggregate`` give the squared distance of a vector to each, ``array_min`` over structs of
distance and number picks the nearest, the smaller number on ties.  New centroids come from sums of columns, one per
component, that each task adds up before anything moves.  The driver holds the centroids and nothing else: ``clusters``
times ``dims`` numbers, whatever the size of the table.

All sums are exact.  Where components are so large that a 64-bit sum could overflow, 38-digit decimals take over; a
squared distance, an inertia or a component beyond the range of 64 bits counts as its end, for the choice of a cluster too.

Kept are vectors with exactly ``dims`` components, none of them null, NaN or infinite; all other rows, null vectors
included, are left out.  Null ids are kept and come last in the order of first centroids.  Repeated ids are rows of
their own; among rows of one id the lesser vector comes first.  Fewer rows than clusters make fewer clusters, none give
an empty table.  Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.llm.frames import staged

#: Clusters, components of a vector, rounds, integer steps of 1.0, prefix of the hashed id.
CLUSTERS, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: Components up to here have distances within 64 bits: (2 * 2^27)^2 * 64 = 2^62.
NARROW = 1 << 27
_MOST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
                    scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, as arrays of integers."""
    raw = F.col(vector_col).cast("array<double>")
    whole = (F.size(raw) == dims) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(raw.isNotNull() & whole)
    # A double beyond 64 bits is cut to the last number that a double and a bigint share.
    ends = (F.lit(float(-(1 << 63))), F.lit(float((1 << 63) - 1024)))
    return kept.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(
        raw, lambda x: F.floor(F.greatest(ends[0], F.least(ends[1], x * float(scale))))).alias("v"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of ``seed:vec_id``, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return [list(r.v) for r in rows]


def _distance(v: Column, centroid: list[int], narrow: bool) -> Column:
    other = F.array(*[F.lit(x).cast("bigint") for x in centroid])
    if narrow:
        squares = F.zip_with(v, other, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)
    gaps = F.zip_with(v, other, F.try_subtract)
    squares = F.transform(gaps, lambda d: F.try_multiply(d, d))
    return F.coalesce(F.aggregate(squares, F.lit(0).cast("bigint"), F.try_add), F.lit(_MOST))


def nearest(v: Column, centroids: list[list[int]], narrow: bool = True) -> Column:
    """Struct of the squared distance to the nearest centroid and its number."""
    return F.array_min(F.array(*[
        F.struct(_distance(v, c, narrow).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]))


def next_centroids(points: DataFrame, centroids: list[list[int]], narrow: bool = True) -> list[list[int]]:
    """Componentwise floor of the mean of each cluster; empty clusters keep their centroid.

    ``points`` has ``v``.  Partial sums are made where the vectors lie; one row per cluster reaches the driver.
    """
    kind = "bigint" if narrow else "decimal(38,0)"
    placed = points.select(nearest(F.col("v"), centroids, narrow)["cluster"].alias("cluster"), "v")
    sums = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[
        F.sum(F.get("v", F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for row in sums.collect():
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(len(centroids[0]))]
    return out


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
                    dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that is kept.

    The vectors are read once per round and once more for the result; only ids, clusters and distances are written.
    """
    points = integer_vectors(vectors, id_col, vector_col, dims, scale)
    spark = vectors.sparkSession
    far = F.greatest(F.array_max("v"), -F.greatest(F.array_min("v"), F.lit(-_MOST)))
    rows, largest = points.agg(F.count("*"), F.max(far)).first()
    if not rows:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    narrow = largest <= NARROW and largest * rows <= _MOST
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds):
        centroids = next_centroids(points, centroids, narrow)
    best = nearest(F.col("v"), centroids, narrow)
    placed = points.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance")
    placed = staged(placed, "centroids-placed")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda n: min(n, _MOST)
    named = F.array(*[F.struct(F.lit(held(sums.get(j, 0))).cast("bigint").alias("inertia"),
                               F.lit(centroid_sha256(c)).alias("sha256")) for j, c in enumerate(centroids)])
    mine = F.get(named, F.col("cluster"))
    return placed.select("vec_id", "cluster", "distance", mine["inertia"].alias("cluster_inertia"),
                         F.lit(held(sum(sums.values()))).cast("bigint").alias("inertia"),
                         mine["sha256"].alias("centroid_sha256"))
