"""Joins to a keyed file that hold up when a few keys carry most of the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from zonedeck.session import fits_broadcast, scans_only, staged

#: A key with more requests than this is spread over several tasks.
ROWS_PER_TASK = 1_000_000
#: Heaviest keys looked at, and keys that the sketch of each task counts at a time.
HOT_KEYS, TRACKED = 2_000, 50_000


def _with_heavy_keys(left: DataFrame, keys: list[str], rows_per_task: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The table, and for each hash of a heavy key into how many salts its rows are dealt.

    A sketch of bounded size counts the keys.  Over a plain scan that is a pass over the key columns; any other
    table is stored, and counted by the same pass, so that whatever made it runs once.
    """
    measured = [F.count(F.lit(1)).alias("n"),
                F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(HOT_KEYS), F.lit(TRACKED)).alias("top")]
    if scans_only(left):
        found = left.agg(*measured).first().asDict()
    else:
        seen = Observation()
        left = staged(left.observe(seen, *measured), "lookup")
        found = seen.get
    heavy = [(r["item"], -(-r["count"] // rows_per_task)) for r in found["top"] or [] if r["count"] > rows_per_task]
    return left, heavy


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], small: bool | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``left`` left-joined to ``right``, which has at most one row per key.

    A right side that was checked to be within the session's broadcast limit is broadcast: no
    shuffle, so no skew.  Otherwise the heaviest request keys get a salt, and only their right-side rows
    are repeated, once per salt value; every other row keeps salt 0.  ``small`` overrides
    the size check where the caller knows better.

    Heavy keys are told by their hash; a key that shares one only gets a salt it did not need.  The salt
    comes from the row's other columns and the number of its input partition: it is the same when a
    lost task is repeated, and equal copies of a row spread too.
    """
    if small is None:
        small = fits_broadcast(right)
    if small:
        return left.join(F.broadcast(right), keys, "left")
    left, heavy = _with_heavy_keys(left, keys, rows_per_task)
    if not heavy:
        return left.join(right, keys, "left")
    # At most HOT_KEYS rows of two numbers.
    hot = F.broadcast(left.sparkSession.createDataFrame(heavy, "_h bigint, _salts int"))
    salted = lambda df: df.withColumn("_h", F.xxhash64(*keys)).join(hot, "_h", "left").drop("_h")
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    others = [F.col(c) for c in left.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*others, F.spark_partition_id()), salts).cast("int")
    salted_left = salted(left).withColumn("_salt", spread).drop("_salts")
    salted_right = salted(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], "left").select(
        *keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
