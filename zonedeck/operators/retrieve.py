"""Two-stage retrieval: rule-promoted notes first, nearest vectors after them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.functions import patterns as P
from zonedeck.operators import cells
from zonedeck.operators.lookup import lookup_join
from zonedeck.operators.programs import tag_rules

# Workers get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors up to this many bytes (as doubles) go to every task as one matrix; more are searched cell by cell, where
#: neither the pivots nor a task's vectors or queries take more.
MATRIX_BYTES = 32 << 20


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = vector_norm(vector)
    return F.transform(vector, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    return 1 - dot / (vector_norm(a) * vector_norm(b))


def _lists(values, valid, width, kind):
    """Lists of ``width`` values, one for each valid row; the others are NULL."""
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(np.where(valid, width, 0))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind), mask=pa.array(~valid))


def _small_side(queries: DataFrame, vectors: DataFrame, vector: str, vec_id: str, k: int) -> DataFrame:
    """Every task holds the whole vector matrix, whose size was checked; queries stay where they are."""
    import pyarrow as pa

    table = vectors.select(vec_id, vector).orderBy(vec_id).toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((table.column(0), cells.unit_rows(table.column(1))))
    k = min(k, table.num_rows)
    at = queries.columns.index(vector)

    def work(batches):
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, cells.SLICE_BYTES // (8 * len(ids)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                valid = part.column(at).is_valid().to_numpy(zero_copy_only=False)
                unit = cells.unit_rows(part.column(at).drop_null())
                order, distance = cells.closest(unit.reshape(len(unit), matrix.shape[1]), matrix, k)
                found = ids.take(pa.array(order.ravel())).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _lists(found, valid, k, found.type), _lists(distance.ravel(), valid, k, pa.float64())],
                    names=[*part.schema.names, "_ids", "_distances"])

    kind = vectors.schema[vec_id].dataType
    out = T.StructType([*queries.schema.fields, T.StructField("_ids", T.ArrayType(kind)),
                        T.StructField("_distances", T.ArrayType(T.DoubleType()))])
    return queries.mapInArrow(work, out)


def _large_side(queries: DataFrame, vectors: DataFrame, vector: str, vec_id: str, k: int, total: int, dim: int,
                most_bytes: int) -> DataFrame:
    """Exact search over cells.  Equal vectors have equal neighbours, whatever id asks; each is searched for once."""
    key = F.struct(F.xxhash64(vector).alias("a"), F.hash(vector).alias("b"))
    queries = queries.withColumn("_key", key)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("_key").alias("_qid"), F.col(vector).alias("_vec"))
    found, _, _ = cells.search_plan(asked.dropDuplicates(["_qid"]), vectors, k, total, dim, vector, vec_id, most_bytes)
    gathered = found.groupBy("_qid").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_vid", "_distance"))).alias("_n"))
    return (queries.join(gathered, queries["_key"] == gathered["_qid"], "left").drop("_qid", "_key")
            .withColumn("_ids", F.col("_n._vid")).withColumn("_distances", F.col("_n._distance")).drop("_n"))


def nearest_lists(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "id",
                  vector: str = "vector", matrix_bytes: int = MATRIX_BYTES, some_without: bool = False) -> DataFrame:
    """Each query with ``neighbours``: its k nearest vectors by cosine distance, exact, ties by id.

    With ``some_without`` queries may lack a vector; their list is NULL.
    """
    def shape(df: DataFrame):
        broken = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull())
        return df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d"), F.min(F.size(vector)).alias("least"),
                      F.count_if(broken).alias("broken")).first()

    size, asked = shape(vectors), shape(queries.where(F.col(vector).isNotNull()) if some_without else queries)
    lengths = {x for s in (size, asked) if s["n"] for x in (s["d"], s["least"])}
    if size["broken"] or asked["broken"] or len(lengths) > 1:
        raise ValueError(f"vectors must have one length and no NULLs; lengths from {min(lengths)} to {max(lengths)}")
    total, dim = size["n"], size["d"] or 1
    if not total:
        none = lambda kind: F.when(F.col(vector).isNotNull(), F.array().cast(kind))
        found = (queries.withColumn("_ids", none(T.ArrayType(vectors.schema[vec_id].dataType)))
                 .withColumn("_distances", none("array<double>")))
    elif total * dim * 8 <= matrix_bytes:
        found = _small_side(queries, vectors, vector, vec_id, k)
    else:
        found = _large_side(queries, vectors, vector, vec_id, k, total, dim, matrix_bytes)
    zipped = F.transform(F.arrays_zip(F.col("_ids").alias("id"), F.col("_distances").alias("distance")), lambda n, i: F.struct(
        (i + 1).alias("rank"), n["id"].alias("id"), n["distance"].alias("distance")))
    return found.withColumn("neighbours", zipped).drop("_ids", "_distances")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", **names) -> DataFrame:
    """``(query_id, rank, id, distance)`` of the k nearest vectors per query."""
    lists = nearest_lists(queries, vectors, k, query_id, **names)
    return lists.select(query_id, F.inline("neighbours"))


def retrieve(queries: DataFrame, chunks: DataFrame, rules: list[tuple[str, str]] = P.KEYWORD_RULES, k: int = 5,
             always: str | None = P.ALWAYS_TAG, query_id: str = "query_id", text: str = "text",
             **names) -> DataFrame:
    """Each query with ``chunk_ids``, its k notes in order.

    The semantic stage asks for k plus the number of matched rules.  Matched notes it returns come
    first, in rule order; the others follow by distance.  A query without a vector gets the notes of
    its matched rules alone, as far as there are such notes.
    """
    vector = F.col(names.get("vector", "vector"))
    there = notes_of_rules(chunks, rules, always, names.get("vec_id", "id"))
    most = k + len({tag for _, tag in rules} | ({always} if always else set()))
    tagged = tag_rules(queries, rules, always, text)
    lists = nearest_lists(tagged, chunks, most, query_id, some_without=True, **names)
    seen = F.transform(F.slice("neighbours", F.lit(1), F.size("tags") + k), lambda n: n["id"].cast("string"))
    promoted = F.filter("tags", lambda t: F.array_contains(F.col("_seen"), t))
    others = F.filter("_seen", lambda s: ~F.array_contains(F.col("tags"), s))
    ranked = F.when(vector.isNull(), kept_notes(F.col("tags"), there)).otherwise(F.concat(promoted, others))
    return (lists.withColumn("_seen", seen).withColumn("chunk_ids", F.slice(ranked, 1, k)).drop("_seen", "neighbours"))


def notes_of_rules(chunks: DataFrame, rules: list[tuple[str, str]], always: str | None, vec_id: str = "id") -> list[str]:
    """Tags for which there is a note; at most one note for a rule is looked up."""
    wanted = sorted({tag for _, tag in rules} | ({always} if always else set()))
    name = F.col(vec_id).cast("string")
    return [r[0] for r in chunks.where(name.isin(wanted)).select(name).distinct().collect()]


def kept_notes(tags: Column, there: list[str]) -> Column:
    """Those of the tags that have a note, in their order."""
    return F.filter(tags, lambda t: t.isin(there) if there else F.lit(False))


def attach_notes(retrieved: DataFrame, chunks: DataFrame, query_id: str = "query_id", vec_id: str = "id",
                 note: str = "text") -> DataFrame:
    """Add ``notes``, the texts of ``chunk_ids`` in the same order.  A note every query asks for is salted."""
    asked = retrieved.select(query_id, F.posexplode("chunk_ids").alias("_at", "_cid"))
    texts = chunks.select(F.col(vec_id).cast("string").alias("_cid"), F.col(note).alias("_note"))
    found = lookup_join(asked, texts, ["_cid"])
    gathered = found.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("_at", "_note"))).alias("_n"))
    return (retrieved.join(gathered, query_id, "left")
            .withColumn("notes", F.coalesce(F.col("_n._note"), F.array().cast("array<string>"))).drop("_n"))


def top_k_chunks(candidates: DataFrame, query_id: str, stage: str, rank: str, chunk_id: str, k: int) -> DataFrame:
    """The table form of the same merge: candidates by (stage, rank), each note once, first k per query.

    A note offered by both stages keeps its better place.  Ranking keeps at most k rows per query
    and partition before the shuffle.
    """
    place = F.struct(F.col(stage), F.col(rank))
    once = candidates.groupBy(query_id, chunk_id).agg(F.min(place).alias("_p"))
    order = Window.partitionBy(query_id).orderBy("_p", chunk_id)
    return (once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
            .select(query_id, "position", chunk_id))


def row_hash(fields: list[str]) -> Column:
    """One hash over the named fields, lengths included so that field borders count."""
    parts = [F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")),
                        F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def content_hash(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """One 64-digit hash of a whole table, whatever the order of its rows.

    Each row's hash is cut into eight numbers that are added up, so the table is folded by ordinary
    partial aggregation and never gathered; the sums and the row count are hashed once more.
    """
    hashed = chunks.select(row_hash(fields).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)")) for i in range(8)]
    sums = hashed.agg(*[w.alias(f"w{i}") for i, w in enumerate(words)], F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(",", *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)], F.col("n").cast("string"))
    return sums.select(F.sha2(text, 256).alias("content_hash"), F.col("n").alias("rows"))


def unchanged(chunks: DataFrame, fields: list[str], stored_hash: str | None) -> bool:
    """Whether a table still has the hash stored with its index, so that a refresh can be skipped."""
    return stored_hash is not None and content_hash(chunks, fields).first()["content_hash"] == stored_hash


def refresh_plan(chunks: DataFrame, index: DataFrame, key: str, fields: list[str], force: bool = False) -> DataFrame:
    """``(key, action)`` with insert, update, delete or keep.  Both tables meet in one grouped shuffle."""
    new = chunks.select(key, row_hash(fields).alias("_new"), F.lit(None).cast("string").alias("_old"))
    old = index.select(key, F.lit(None).cast("string").alias("_new"), row_hash(fields).alias("_old"))
    met = new.unionByName(old).groupBy(key).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    same = F.lit(False) if force else F.col("_new") == F.col("_old")
    action = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
              .when(same, "keep").otherwise("update"))
    return met.select(key, action.alias("action"))


# The frame around retrieved notes in a prompt.
RULES_HEAD = "\nCOBOL SYNTAX REFERENCE (retrieved for this specific program)\n"
RULES_LINE = "─" * 60 + "\n"
RULES_TAIL = "Apply the rules above when translating the program below.\n"
FIRST_REQUEST = "Initial translation request."


def render_prompt(df: DataFrame, base: str, notes: str = "notes") -> DataFrame:
    """Add ``system_prompt``: the base text, and the notes numbered below it when there are any."""
    numbered = F.array_join(F.transform(F.col(notes), lambda c, i: F.concat(
        F.lit("[Rule "), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    framed = F.concat(F.lit(base + RULES_HEAD + RULES_LINE), numbered, F.lit("\n" + RULES_LINE + RULES_TAIL))
    return df.withColumn("system_prompt", F.when(F.coalesce(F.size(notes), F.lit(0)) <= 0, F.lit(base)).otherwise(framed))


def render_request(df: DataFrame, source: str = "text", feedback: str | None = None) -> DataFrame:
    """Add ``user_prompt``: the program, and feedback on every attempt but the first."""
    asked = F.concat(F.lit("COBOL source to translate:\n\n```cobol\n"), F.col(source), F.lit("\n```"))
    if feedback:
        note = F.concat(F.lit("\n\nFeedback from previous attempt (fix this):\n"), F.col(feedback))
        again = F.col(feedback).isNotNull() & (F.col(feedback) != FIRST_REQUEST)
        asked = F.concat(asked, F.when(again, note).otherwise(""))
    return df.withColumn("user_prompt", asked)
