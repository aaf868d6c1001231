"""Checking the output of a migrated job against the output it has to reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonedeck.functions.compare import TOLERANCE, TOKEN, numeric_tokens, token_pairs, verdict


def check_equivalence(pairs: DataFrame, expected: str = "expected", actual: str = "actual",
                      tolerance: str = TOLERANCE, strip_plus: bool = False) -> DataFrame:
    """Add ``verdict``, ``tokens`` and ``diffs`` (positions whose values differ by more than the tolerance).

    A value that differs by exactly the tolerance passes.
    """
    limit = F.lit(tolerance).cast(TOKEN)
    e, a = F.col(expected), F.col(actual)
    # Each list is built in a projection of its own, so that what reads it does not extract it again.
    compared = (pairs.withColumn("_e_tokens", numeric_tokens(e)).withColumn("_a_tokens", numeric_tokens(a))
                .withColumn("_pairs", token_pairs(F.col("_e_tokens"), F.col("_a_tokens"))))
    located = F.transform(F.col("_pairs"), lambda p, i: F.struct(
        (i + 1).alias("token"), p["expected"].alias("expected"), p["actual"].alias("actual"), p["diff"].alias("diff")))
    judged = verdict(e, a, F.col("_e_tokens"), F.col("_a_tokens"), F.col("_pairs"), limit, strip_plus)
    return (compared.withColumn("verdict", judged)
            .withColumn("tokens", F.size("_e_tokens"))
            .withColumn("diffs", F.when(F.col("verdict") == "value_mismatch",
                                        F.filter(located, lambda d: d["diff"] > limit)))
            .drop("_pairs", "_e_tokens", "_a_tokens"))


def diff_rows(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing value, with the line to report."""
    rows = checked.select(*keys, F.explode("diffs").alias("d")).select(*keys, "d.*")
    message = F.format_string("Token %d: expected=%s actual=%s diff=%s", "token", "expected", "actual",
                              F.col("diff").cast("decimal(38,4)").cast("string"))
    return rows.withColumn("message", message)


def reconcile(expected: DataFrame, actual: DataFrame, key: str, text: str = "text",
              tolerance: str = TOLERANCE) -> DataFrame:
    """Pair two sides by key and compare; a side that is missing or repeats the key is its own verdict.

    Both sides are stacked and grouped once, so there is a single shuffle, and repeats of a key
    collapse before it.
    """
    sides = (expected.select(key, F.col(text).alias("expected"), F.lit(None).cast("string").alias("actual"),
                             F.lit(1).cast("bigint").alias("_e"), F.lit(0).cast("bigint").alias("_a"))
             .unionByName(actual.select(key, F.lit(None).cast("string").alias("expected"),
                                        F.col(text).alias("actual"),
                                        F.lit(0).cast("bigint").alias("_e"), F.lit(1).cast("bigint").alias("_a"))))
    paired = sides.groupBy(key).agg(F.max("expected").alias("expected"), F.max("actual").alias("actual"),
                                    F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    checked = check_equivalence(paired, tolerance=tolerance)
    sided = (F.when((F.col("_e") > 1) | (F.col("_a") > 1), "duplicate_key")
             .when(F.col("_e") == 0, "missing_expected").when(F.col("_a") == 0, "missing_actual")
             .otherwise(F.col("verdict")))
    return checked.withColumn("verdict", sided).drop("_e", "_a")
