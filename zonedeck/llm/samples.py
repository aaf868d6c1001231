"""Bounded samples of labelled documents for the models, and the folds that they keep away from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, most: int,
                    longest: int = 1 << 16) -> list[tuple[bytes, int]]:
    """At most ``most`` pairs of text and label, half from either label as far as there are enough.

    ``allowed`` is a condition on ``doc_id``.  The rows of least hash of the id are taken, so that the sample does not
    hang on the order of files; texts of more than ``longest`` bytes are not sampled, which bounds what the driver
    gets.  Rows with a null id or label are never taken.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(allowed & F.col("label").isin(0, 1))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    found = []
    for label in (0, 1):
        ids = rows.where(F.col("label") == label).select("doc_id").distinct().orderBy(*order).limit(most // 2)
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # At most ``most / 2`` ids are broadcast.
        texts = texts.where(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
        taken = texts.orderBy(*order).limit(most // 2).collect()
        found += [(r.text.encode("utf-8", "surrogatepass"), label) for r in taken]
    return found


def share_of(labels: DataFrame, label_col: str, allowed: Column) -> float:
    """Share of label 1 among the allowed rows; one half without rows."""
    row = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        allowed & F.col("label").isin(0, 1)).agg(F.avg("label")).first()
    return 0.5 if row[0] is None else float(row[0])
