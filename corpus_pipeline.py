"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and all rows that its predecessor kept.  All but the last return the columns of
``documents``; the last adds token ids.  How nulls, empty texts, repeated rows and further columns are treated stands in
the docstring of each operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonedeck.llm import bpe, decontaminate, lines, quality_rules, simhash
from zonedeck.llm.frames import free_name, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat a line of an earlier document or place, give or take two edits, go; ``n_chars`` follows the text."""
    kept, n, removed, near = (free_name(docs, c) for c in ("_kept", "_lines", "_removed", "_near"))
    done = lines.dedup_lines(docs, out=kept, counts=(n, removed, near))
    changed = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(removed) > 0, F.char_length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; fingerprints of four-word shingles link at four bits or fewer."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text that is left, their number, and a hash of the bytes that they decode to."""
    ids, decoded = free_name(docs, "token_ids"), free_name(docs, "_decoded")
    done = bpe.encode_documents(docs, bpe.public_vocabulary(), ids_col=ids, decoded_col=decoded)
    return done.select(*docs.columns, ids, (F.octet_length(ids) / 4).cast("bigint").alias(free_name(docs, "n_tokens")),
                       F.sha2(decoded, 256).alias(free_name(docs, "decoded_sha256")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", apply_quality_rules),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode),
]

#: Posteriors by expectation-maximisation, an edit join and token merges are beyond SQL at this size; the tests of the
#: operators hold them against brute-force versions, and a test of the pipeline runs all stages over a small table.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
