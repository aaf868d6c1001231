"""Positions and running totals in a total order, without one task per key.

A window over (key, order) puts a whole key into one task, which is the right plan for keys of
ordinary size.  Keys of more than ``KEY_ROWS`` rows are found by a counted aggregate; for them, and
for a total order without keys, the order is first cut into ranges at rows of a small sample.  The cuts are whole
order values of any type and length, so rows spread evenly whatever their first column or characters look like.
Totals per (key, range) are summed with map-side
combine, turned into starting offsets, and joined back, so a task only ever sorts one
range of one key.  Order columns must not be NULL and must together be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a key that one task sorts.
KEY_ROWS = 1_000_000
#: Rows of the sample for each range.
SAMPLE_ROWS = 20


def splitters(df: DataFrame, order: list[str], ranges: int, apart: list[str] = ()) -> list[Row]:
    """Order values that cut the rows into about ``ranges`` even ranges: every so many rows of a sorted sample.

    The sample has ``SAMPLE_ROWS`` rows for each range, those of least hash; rows that agree in the order are told
    apart by the columns ``apart``.
    """
    sample = df.select(*order, F.xxhash64(*apart, *order).alias("_h")).orderBy("_h", *order).limit(ranges * SAMPLE_ROWS)
    rows = sample.select(*order).orderBy(*order).collect()
    step = max(1, len(rows) // ranges)
    return rows[step::step][: ranges - 1]


def _literal(row: Row, order: list[str], schema: T.StructType) -> Column:
    return F.struct(*[F.lit(row[c]).cast(schema[c].dataType).alias(c) for c in order])


def range_of(order: list[str], schema: T.StructType, cuts: list[Row]) -> Column:
    """Number of the range that a row falls into: how many cuts it does not come before.

    Only some cuts are compared first, then those between two of them.
    """
    if not cuts:
        return F.lit(0)
    at, step = F.struct(*order), max(1, round(len(cuts) ** 0.5))
    groups = [[_literal(c, order, schema) for c in cuts[i:i + step]] for i in range(0, len(cuts), step)]
    passed = lambda tried: F.size(F.filter(tried, lambda c: c <= at))
    fine = F.array(*[F.array(*g) for g in groups])
    return F.get(F.transform(F.array(passed(F.array(*[g[0] for g in groups]))), lambda n: F.when(n == 0, 0).otherwise(
        (n - 1) * step + passed(F.get(fine, n - 1)))), F.lit(0))


def with_ranges(df: DataFrame, order: list[str], ranges: int, apart: list[str] = ()) -> DataFrame:
    """Add ``_b``, which rises with the order."""
    return df.withColumn("_b", range_of(order, df.schema, splitters(df, order, ranges, apart)))


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str,
                  buckets: int | None = None, descending: bool = False) -> DataFrame:
    """Add the running sum of ``weight`` per key along ``order``, the current row included.

    ``buckets`` forces that many ranges for all keys.
    """
    way = F.desc if descending else F.asc
    if keys and not buckets:
        key = F.struct(*keys)
        # At most one key for every KEY_ROWS rows of the table.
        large = df.groupBy(key.alias("_large")).count().where(F.col("count") > KEY_ROWS).select("_large")
        whole = Window.partitionBy(*keys).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        if not large.take(1):
            return df.withColumn(out, F.sum(weight).over(whole))
        met = key.eqNullSafe(F.col("_large"))
        small = df.join(F.broadcast(large), met, "left_anti").withColumn(out, F.sum(weight).over(whole))
        split = running_total(df.join(F.broadcast(large), met, "left_semi"), keys, order, weight, out,
                              max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), descending)
        return small.unionByName(split)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The keys travel as one struct, which is never NULL itself: windows, totals and the join then all
    # use the same plain columns, so the rows are shuffled once.
    key = F.struct(*keys) if keys else F.lit(0)
    placed = with_ranges(df, order, max(2, buckets), keys).withColumn("_w", weight).withColumn("_key", key)
    before = Window.partitionBy("_key").orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_key", "_b").agg(F.sum("_w").alias("_total"))
               .select("_key", "_b", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_key", "_b").orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    # Without keys there is one row for each range.
    return (placed.withColumn("_inside", F.sum("_w").over(inside))
            .join(offsets if keys else F.broadcast(offsets), ["_key", "_b"])
            .withColumn(out, F.col("_inside") + F.col("_offset"))
            .select(*df.columns, out))


def position(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """1-based position per key along ``order``."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, buckets)
