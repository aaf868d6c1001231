"""Queries over notes and vectors: documents carry the texts, embeddings their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.operators import retrieve as R
from zonedeck.plans import carriers as C
from zonedeck.plans.program_jobs import _word
from zonedeck.plans.registry import query
from zonedeck.session import shared_dir, spread
from zonedeck.sources.corpus import audit_knowledge, load_knowledge

K = 5
ALWAYS = "7"
# Rules that promote notes: pattern, the same for DuckDB, note id.
NOTE_RULES = [
    (r"(?iU)\bthe\b", _word("the"), "3"), (r"(?iU)\bque\b", _word("que"), "11"), (r"[0-9]{2}", r"[0-9]{2}", "25"),
    (r"(?iU)\band\b", _word("and"), "42"), (r"(?iU)\bla\b", _word("la"), "58"), (r"(?iU)\bund\b", _word("und"), "60"),
    (r"[.]\s", r"[.]\s", "101"), (r"(?iU)\bof\b", _word("of"), "7"), (r"(?i)https?:", r"(?i)https?:", "130"),
    (r"(?iU)\bin\b", _word("in"), "155"), (r",", r",", "200"),
]


def knowledge(spark, sf_dir):
    documents = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", "lang", "text")
    folder = shared_dir(spark, "notes")
    (documents.select("id", F.col("source").alias("topic"), F.array("lang", "source").alias("tags"), "text")
     .write.json(folder))
    return folder


@query("load_knowledge", """
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS topic, concat(lang, ',', source) AS tags, md5(text) AS digest FROM documents""")
def load_notes(spark, sf_dir):
    notes = load_knowledge(spark, knowledge(spark, sf_dir), check=False)
    return notes.select("id", "topic", F.array_join("tags", ",").alias("tags"), F.md5("text").alias("digest"))


@query("audit_knowledge", """
    SELECT count(*) AS notes, CAST(0 AS BIGINT) AS missing_keys, count(*) FILTER (length(text) <= 20) AS short_texts,
           count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents""")
def audit_notes(spark, sf_dir):
    return audit_knowledge(load_knowledge(spark, knowledge(spark, sf_dir), check=False))


@query("vector_norms", """
    SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(1 - list_cosine_similarity(v, w), 6) AS distance
    FROM (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS v, CAST(b.embedding AS DOUBLE[]) AS w
          FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def vector_norms(spark, sf_dir):
    """Length of each vector and its distance to the next one by id."""
    vectors = C.table(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = vectors.join(following, "vec_id", "left")
    return both.select("vec_id", F.round(R.vector_norm(F.col("embedding")), 6).alias("norm"),
                       F.round(R.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


_NEAREST = """
    (SELECT q.vec_id AS query_id, v.vec_id AS id,
            1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance
     FROM embeddings q, embeddings v)"""
# Notes are documents that have a vector, so only those are ranked.
_NOTES = f"""
    (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM {_NEAREST} n
     WHERE id IN (SELECT doc_id FROM documents) AND query_id IN (SELECT doc_id FROM documents))"""
_RANKED = f"""
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM {_NEAREST})"""
_NEAREST_SQL = f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM {_RANKED} WHERE rank <= {K}"


def found(spark, sf_dir, **options):
    vectors = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = spread(vectors).withColumnRenamed("id", "query_id")
    near = R.nearest(queries, vectors, K, **options)
    return near.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("nearest", _NEAREST_SQL)
def nearest(spark, sf_dir):
    return found(spark, sf_dir)


@query("nearest_blocks", _NEAREST_SQL)
def nearest_blocks(spark, sf_dir):
    """The same with a matrix limit small enough to force the cell-and-block search."""
    return found(spark, sf_dir, matrix_bytes=1 << 16)


def notes_and_queries(spark, sf_dir):
    vectors = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    texts = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    # Every document asks; the notes are those that have a vector.
    asked = spread(texts).join(vectors, "id", "left")
    return texts.join(vectors, "id"), asked.withColumnRenamed("id", "query_id")


def retrieved(spark, sf_dir):
    chunks, queries = notes_and_queries(spark, sf_dir)
    return chunks, R.retrieve(queries, chunks, [(p, t) for p, _, t in NOTE_RULES], K, ALWAYS)


def _tags_sql():
    hits = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for _, p, t in NOTE_RULES if t != ALWAYS)
    return f"(SELECT doc_id, list_filter(['{ALWAYS}', {hits}], lambda t: t IS NOT NULL) AS tags FROM documents)"


_STAGED = f"""
    (SELECT r.query_id, CAST(r.id AS VARCHAR) AS chunk_id, r.rank,
            list_position(t.tags, CAST(r.id AS VARCHAR)) AS rule
     FROM {_NOTES} r JOIN {_tags_sql()} t ON t.doc_id = r.query_id WHERE r.rank <= {K} + len(t.tags))"""
_ORDERED = f"""
    (SELECT query_id, chunk_id, row_number() OVER (
         PARTITION BY query_id ORDER BY CASE WHEN rule > 0 THEN 0 ELSE 1 END, CASE WHEN rule > 0 THEN rule ELSE rank END) AS position
     FROM {_STAGED}
     UNION ALL
     SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY p)
     FROM (SELECT doc_id, unnest(tags) AS t, unnest(range(1, len(tags) + 1)) AS p
           FROM {_tags_sql()} WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))
     WHERE t IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)))"""


@query("retrieve", f"""
    SELECT query_id, string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids
    FROM {_ORDERED} WHERE position <= {K} GROUP BY query_id""")
def retrieve(spark, sf_dir):
    _, lists = retrieved(spark, sf_dir)
    return lists.select("query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("top_k_chunks", f"SELECT query_id, CAST(position AS INTEGER) AS position, chunk_id FROM {_ORDERED} WHERE position <= {K}")
def top_k_chunks(spark, sf_dir):
    """The merge from a table of candidates, where promoted notes are offered by both stages."""
    chunks, queries = notes_and_queries(spark, sf_dir)
    rules = [(p, t) for p, _, t in NOTE_RULES]
    near = R.nearest_lists(R.tag_rules(queries, rules, ALWAYS), chunks, K + len({t for _, t in rules}), some_without=True)
    # Texts that have no vector come with the notes of their rules alone.
    ruled = F.transform(R.kept_notes(F.col("tags"), R.notes_of_rules(chunks, rules, ALWAYS)), lambda t, i: F.struct(
        t.alias("chunk_id"), F.lit(0).alias("stage"), (i + 1).cast("bigint").alias("rank")))
    ranked = F.filter("neighbours", lambda n: n["rank"] <= F.size("tags") + K)
    semantic = F.transform(ranked, lambda n: F.struct(
        n["id"].cast("string").alias("chunk_id"), F.lit(1).alias("stage"), n["rank"].cast("bigint").alias("rank")))
    promoted = F.transform(F.filter(ranked, lambda n: F.array_contains("tags", n["id"].cast("string"))), lambda n: F.struct(
        n["id"].cast("string").alias("chunk_id"), F.lit(0).alias("stage"),
        F.array_position("tags", n["id"].cast("string")).alias("rank")))
    offered = F.when(F.col("vector").isNull(), ruled).otherwise(F.concat(semantic, promoted))
    return R.top_k_chunks(near.select("query_id", F.inline(offered)), "query_id", "stage", "rank", "chunk_id", K)


_HASHED = """sha256(concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id, length(text), ':', text))"""


@query("content_hash", f"""
    SELECT sha256(concat({", ',', ".join(f"w{i}" for i in range(8))}, ',', n)) AS content_hash, n AS rows
    FROM (SELECT {", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS UBIGINT)) AS HUGEINT) AS w{i}" for i in range(8))}, count(*) AS n
          FROM (SELECT {_HASHED} AS h FROM documents))""")
def content_hash(spark, sf_dir):
    return R.content_hash(spread(C.table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id", "text"])


_NEW = """(SELECT CASE WHEN doc_id % 20 = 0 THEN -doc_id - 1 ELSE doc_id END AS id,
                  CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END AS text, source FROM documents)"""


@query("refresh_plan", f"""
    SELECT coalesce(n.id, d.doc_id) AS id,
           CASE WHEN d.doc_id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN n.text = d.text THEN 'keep' ELSE 'update' END AS action
    FROM {_NEW} n FULL JOIN documents d ON d.doc_id = n.id""")
def refresh_plan(spark, sf_dir):
    index = spread(C.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", "source")
    moved = F.when(F.col("id") % 20 == 0, -F.col("id") - 1).otherwise(F.col("id"))
    edited = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    chunks = index.select(moved.alias("id"), edited.alias("text"), "source")
    return R.refresh_plan(chunks, index, "id", ["text", "source"])


@query("refresh_skip", f"""
    SELECT 'same' AS source, true AS skipped, count(*) AS rows FROM documents
    UNION ALL
    SELECT 'edited', count(*) FILTER (n.text <> d.text OR n.id IS NULL OR d.doc_id IS NULL) = 0, count(*) FILTER (n.id IS NOT NULL)
    FROM {_NEW} n FULL JOIN documents d ON d.doc_id = n.id""")
def refresh_skip(spark, sf_dir):
    """A refresh against the hash that was stored with the index, for the same table and for an edited one."""
    index = spread(C.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", "source")
    stored = R.content_hash(index, ["id", "text", "source"]).first()["content_hash"]
    moved = F.when(F.col("id") % 20 == 0, -F.col("id") - 1).otherwise(F.col("id"))
    edited = index.select(moved.alias("id"), F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(
        F.col("text")).alias("text"), "source")
    parts = [rows.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("source"), F.lit(R.unchanged(rows, ["id", "text", "source"], stored)).alias("skipped"), "rows")
        for name, rows in (("same", index), ("edited", edited))]
    return parts[0].unionByName(parts[1])


BASE = "You translate programs.\n"


@query("render_prompt", f"""
    WITH notes AS (SELECT o.query_id, string_agg(concat('[Rule ', o.position, '] ', d.text), chr(10) || chr(10) ORDER BY o.position) AS joined
                   FROM {_ORDERED} o JOIN documents d ON CAST(d.doc_id AS VARCHAR) = o.chunk_id
                   WHERE o.position <= {K} GROUP BY 1)
    SELECT query_id, md5(concat('{BASE}', '{R.RULES_HEAD}', '{R.RULES_LINE}', joined, chr(10), '{R.RULES_LINE}', '{R.RULES_TAIL}')) AS prompt,
           md5(concat('COBOL source to translate:', chr(10), chr(10), '```cobol', chr(10), text, chr(10), '```')) AS request
    FROM notes JOIN documents ON doc_id = query_id""")
def render_prompt(spark, sf_dir):
    chunks, lists = retrieved(spark, sf_dir)
    prompts = R.render_request(R.render_prompt(R.attach_notes(lists, chunks), BASE))
    return prompts.select("query_id", F.md5("system_prompt").alias("prompt"), F.md5("user_prompt").alias("request"))
