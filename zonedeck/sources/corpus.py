"""Reading source programs and knowledge notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWLEDGE_SCHEMA = "id string, topic string, tags array<string>, text string"
MIN_TEXT = 20


def load_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per program: ``path`` and the whole ``text``.

    A folder is listed in one go.  Spark looks up every file that a pattern matches on its own, so for very many files
    the folder is the better choice.
    """
    return (spark.read.text(pattern, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


#: Stands between programs that share a file; no program may contain it.
SEPARATOR = "\x1e\x1d\n"


def store_programs(corpus: DataFrame, folder: str, key: str = "path", text: str = "text") -> None:
    """Write programs one after the other, one file per task: the key on a line of its own, then the text.

    A key with a line end, a NULL, or a text that contains the separator raises.
    """
    k, t = F.col(key).cast("string"), F.col(text)
    broken = k.isNull() | t.isNull() | F.contains(k, F.lit("\n")) | F.contains(F.concat(k, t), F.lit(SEPARATOR))
    value = F.when(~broken, F.concat(k, F.lit("\n"), t)).otherwise(
        F.raise_error(F.concat(F.lit("cannot be stored: "), F.coalesce(k, F.lit("a program without a key")))).cast("string"))
    corpus.select(value.alias("value")).write.option("lineSep", SEPARATOR).text(folder)


def load_programs(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of programs that ``store_programs`` wrote.

    A file is read in splits, each from the first separator in it on, so many programs in few files spread over all tasks.
    """
    rows = spark.read.option("lineSep", SEPARATOR).text(path)
    at = F.instr("value", "\n")
    return rows.select(F.left("value", at - 1).alias("path"), F.substring("value", at + 1, F.length("value")).alias("text"))


def audit_knowledge(chunks: DataFrame) -> DataFrame:
    """One row of counts: notes, missing keys, short texts, ids used more than once."""
    missing = F.col("id").isNull() | F.col("topic").isNull() | F.col("tags").isNull() | F.col("text").isNull()
    per_id = chunks.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) <= MIN_TEXT).alias("short"))
    zero = F.lit(0).cast("bigint")
    return per_id.agg(F.coalesce(F.sum("n"), zero).alias("notes"),
                      F.coalesce(F.sum("missing"), zero).alias("missing_keys"),
                      F.coalesce(F.sum("short"), zero).alias("short_texts"),
                      F.count_if(F.col("n") > 1).alias("repeated_ids"))


def load_knowledge(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Notes ``(id, topic, tags, text)`` from JSON lines; with ``check`` a broken table raises."""
    chunks = spark.read.schema(KNOWLEDGE_SCHEMA).json(path)
    if check:
        found = audit_knowledge(chunks).first().asDict()
        broken = {k: v for k, v in found.items() if k != "notes" and v}
        if broken:
            raise ValueError(f"knowledge table {path}: {broken}")
    return chunks
