"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonedeck.llm import (
    bpe, centroids, decontaminate, divergence, fingerprints, lines, pii, quality_model, quality_rules, sharding, simhash,
    substrings, toxicity,
)
from zonedeck.llm.frames import id_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check.strip()
        return fn

    return keep


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_REPEATS_SQL = f"""
    WITH split AS (SELECT doc_id, {_WORDS} AS words FROM documents),
         windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
                     FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split)),
         least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
         gone AS (SELECT DISTINCT doc_id, p FROM (
                      SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (w) WHERE first < doc_id)),
         places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split),
         kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
                  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT s.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM split s LEFT JOIN kept k USING (doc_id)"""

_LEAKS_SQL = f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS words FROM benchmark),
         grams AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS g
                   FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
         split AS (SELECT doc_id, {_FOLDED} AS words FROM documents),
         sizes AS (SELECT DISTINCT n FROM grams),
         places AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
                    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM split, sizes)),
         hits AS (SELECT doc_id, item, n, i FROM places JOIN grams USING (n, g)),
         words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
         items_hit AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
                       FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT s.doc_id, len(words) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
           sha256(coalesce(m.list, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
    FROM split s LEFT JOIN words_hit w USING (doc_id) LEFT JOIN items_hit m USING (doc_id)"""

#: One round: every vector to its nearest centroid, then the floors of the means; empty clusters keep their centroid.
_ROUND = """
         far{r} AS (SELECT p.vec_id, k.c, sum((p.x - k.x) * (p.x - k.x)) AS d FROM points p JOIN cent{q} k USING (i) GROUP BY 1, 2),
         near{r} AS (SELECT vec_id, c, d FROM (
                         SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM far{r}) WHERE k = 1),
         mean{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM near{r} JOIN points USING (vec_id) GROUP BY 1, 2),
         cent{r} AS (SELECT c, i, coalesce((s - (s % n + n) % n) // n, x) AS x FROM cent{q} LEFT JOIN mean{r} USING (c, i)),"""

_CENTROIDS_SQL = f"""
    WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64),
         raw AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, 65)) AS i FROM kept),
         bad AS (SELECT DISTINCT vec_id FROM raw WHERE x IS NULL OR isnan(x) OR isinf(x)),
         points AS (SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM raw ANTI JOIN bad USING (vec_id)),
         start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c
                   FROM (SELECT DISTINCT vec_id FROM points)),
         cent0 AS (SELECT c, i, x FROM start JOIN points USING (vec_id) WHERE c < 16),
         {"".join(_ROUND.format(r=r, q=r - 1) for r in (1, 2, 3))}
         last AS (SELECT p.vec_id, k.c, sum((p.x - k.x) * (p.x - k.x)) AS d FROM points p JOIN cent3 k USING (i) GROUP BY 1, 2),
         near AS (SELECT vec_id, c, d FROM (
                      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM last) WHERE k = 1),
         named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM cent3 GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
           CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           h AS centroid_sha256
    FROM near JOIN named USING (c)"""

_DIVERGENCE_SQL = r"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
         tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
         vocab AS (SELECT lang, term, count(*) AS m FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
         counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN vocab USING (lang, term) GROUP BY 1, 2, 3),
         langs AS (SELECT lang, count(*) AS v, sum(m) AS total FROM vocab GROUP BY 1),
         groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
                    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2) s USING (lang, source)),
         cells AS (SELECT lang, g.source, term, coalesce(c.n, 0) AS n, m, l.total AS lang_total, v,
                          1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS HUGEINT) // (g.total + 5 * v) AS p
                   FROM groups g JOIN vocab USING (lang) JOIN langs l USING (lang)
                   LEFT JOIN counts c USING (lang, source, term)),
         apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                   FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
         pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
                   FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
         above AS (SELECT lang, source, term AS item, p - (1 + CAST(1000000000 * (m + 5) AS HUGEINT) // (lang_total + 5 * v)) AS value
                   FROM cells WHERE n > 0),
         ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS k FROM pairs
                    UNION ALL
                    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
                                          row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS k
                                   FROM above WHERE value > 0) WHERE k <= 50)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked"""


@_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op2_recompression", _REPEATS_SQL)
def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(id_text(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@_query("op3_decontaminate", _LEAKS_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = id_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, benchmark)
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@_query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    # No filter on the kind here: a second parameter of its function, such as ``k=k``, would be the place in the array.
    kinds = F.transform("base", lambda c: c["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k + 1))).cast("bigint").alias(f"n_{name}")
              for k, name in enumerate(pii.KINDS)]
    everything = F.array_sort(F.array_union("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(everything).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


@_query("op5_lines")
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(id_text(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_lines", "n_removed", "n_near",
                       F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    done = bpe.encode_documents(docs, bpe.public_vocabulary(), decoded_col="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.assess(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "p_good")


@_query("op8_byte_cnn")
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_label_propagation")
def op10_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query("op11_centroids", _CENTROIDS_SQL)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


@_query("op12_divergence", _DIVERGENCE_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@_query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprints.sketch_text(F.col("sketch")).alias("fingerprint"),
                        fingerprints.sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited",
                        "near_next", "in_edited", "n_shingles")
