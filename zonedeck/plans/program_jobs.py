"""Queries over a corpus of source programs, rendered from orders and parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from zonedeck.functions import patterns as P
from zonedeck.operators import programs as S
from zonedeck.plans import carriers as C
from zonedeck.plans.registry import query
from zonedeck.session import shared_dir, spread, staged
from zonedeck.sources.corpus import load_corpus as read_corpus
from zonedeck.sources.corpus import load_programs as read_programs
from zonedeck.sources.corpus import store_programs


def programs(spark, sf_dir):
    return C.PROGRAMS.df(spark, sf_dir)


def _any(*found):
    return "(" + " OR ".join(found) + ")"


def _re2(pattern):
    """The pattern for DuckDB: its texts here are ASCII, where the Unicode flag makes no difference."""
    return re.sub(r"^\(\?([a-z]*)U\)", r"(?\1)", pattern)


def _has(pattern, column="text"):
    return f"regexp_matches({column}, '{_re2(pattern)}')"


_VSAM = _any(_has(P.PACKED_USAGE), _has(P.DATASET_HINT))
_BLOCKS = f"regexp_extract_all(text, '{_re2(P.COMMAND_BLOCK)}')"
_EXPLODED = f"""
    (SELECT path, unnest(b) AS original, unnest(range(1, len(b) + 1)) AS pos
     FROM (SELECT path, {_BLOCKS} AS b FROM {C.PROGRAMS.sql}))"""
# A record starts at a line with level 01; DuckDB has no lookahead, so the text is cut at marked starts.
_CUT = r"string_split(regexp_replace(text, '(?m)^([ \t]*01\s)', chr(1) || '\1', 'g'), chr(1))[2:]"
_RECORDS = f"""list_filter({_CUT}, lambda r: {_any(_has(P.PACKED_USAGE, 'r'), _has(P.BINARY_USAGE, 'r'))})"""


@query("load_corpus", f"""
    SELECT path, length(text) + 1 AS size, md5(text || chr(10)) AS digest FROM {C.STORED_PROGRAMS.sql}""")
def load_corpus(spark, sf_dir):
    """Programs are written as one text file each (a line end closes the file), then read back whole."""
    folder = shared_dir(spark, "programs")
    (C.STORED_PROGRAMS.df(spark, sf_dir).select(F.col("text").alias("value"))
     .repartition(spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 1)
     # Tasks move their own files; the driver would move them one after the other.
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder))
    loaded = read_corpus(spark, folder)
    number = F.regexp_extract("text", r"PROGRAM-ID\. SUP(\d+)\.", 1).cast("bigint")
    return loaded.select(number.alias("path"), F.length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


@query("load_programs", f"SELECT path, length(text) AS size, md5(text) AS digest FROM {C.PROGRAMS.sql}")
def load_programs(spark, sf_dir):
    """All programs stored in as many files as there are tasks, and read back in splits."""
    folder = shared_dir(spark, "packed-programs")
    store_programs(programs(spark, sf_dir), folder)
    return read_programs(spark, folder).select(F.col("path").cast("bigint").alias("path"),
                                               F.length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


@query("detect_constructs", f"""
    SELECT path, {_has(P.COMMAND_BLOCK)} AS cics, {_VSAM} AS vsam FROM {C.PROGRAMS.sql}""")
def detect_constructs(spark, sf_dir):
    return S.detect_constructs(programs(spark, sf_dir)).drop("text")


def _tags_sql(rules, always):
    cases = ", ".join(f"CASE WHEN {_has(p)} THEN '{t}' END" for p, t in rules if t != always)
    first = f"'{always}', " if always else ""
    return f"array_to_string(list_filter([{first}{cases}], lambda t: t IS NOT NULL), ',')"


@query("tag_rules", f"SELECT path, {_tags_sql(P.KEYWORD_RULES, P.ALWAYS_TAG)} AS tags FROM {C.PROGRAMS.sql}")
def tag_rules(spark, sf_dir):
    return S.tag_rules(programs(spark, sf_dir)).select("path", F.array_join("tags", ",").alias("tags"))


def _word(word):
    """A whole word by Unicode letters, for DuckDB, whose ``\\b`` knows ASCII only."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


# Rules for prose, kept as a table: order, pattern, the same for DuckDB, tag.
PROSE_RULES = [
    (1, r"(?iU)\bthe\b", _word("the"), "english"),
    (2, r"(?iU)\bque\b|\bune\b", _word("(que|une)"), "french"),
    (3, r"[0-9]{3}", r"[0-9]{3}", "digits"),
    (4, r"https?://", r"https?://", "link"),
    (5, r"(?i)licen[sc]e|copyright", r"(?i)licen[sc]e|copyright", "licence"),
    (6, r"[^\s]+@[^\s]+", r"[^\s]+@[^\s]+", "mail"),
    (7, r"(?iU)\band\b", _word("and"), "english"),
    (8, r"(?iU)\bder\b|\bund\b", _word("(der|und)"), "german"),
]


def _prose_sql():
    """A tag stands where the first of its rules that matched stands."""
    hits = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for _, _, p, t in PROSE_RULES)
    return f"""
    SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i),
                                                  lambda i: l[i]), ',') AS tags
    FROM (SELECT doc_id, list_filter([{hits}], lambda t: t IS NOT NULL) AS l FROM documents)"""


@query("tag_rules_table", _prose_sql())
def tag_rules_table(spark, sf_dir):
    """Whole documents against a rule table; two rules share a tag."""
    rules = spark.createDataFrame([(n, p, t) for n, p, _, t in PROSE_RULES], "ord int, pattern string, tag string")
    docs = spread(C.table(spark, sf_dir, "documents")).select("doc_id", "text")
    return S.tag_rules(docs, rules, always=None).select("doc_id", F.array_join("tags", ",").alias("tags"))


#: Rules of the long table: the first words of the documents' vocabulary.  Rules of words that start alike share a tag.
LONG_RULES = 10_000


@query("tag_rules_long", rf"""
    WITH split AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS words FROM documents),
         tokens AS (SELECT doc_id, unnest(words) AS word FROM split),
         rules AS (SELECT DISTINCT word FROM tokens WHERE regexp_full_match(word, '[a-z]{{4,}}') ORDER BY word LIMIT {LONG_RULES}),
         tags AS (SELECT doc_id, left(word, 3) AS tag, min(word) AS first FROM tokens JOIN rules USING (word) GROUP BY 1, 2),
         lists AS (SELECT doc_id, count(*) AS n, string_agg(tag, ',' ORDER BY first) AS tags FROM tags GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_tags, md5(coalesce(tags, '')) AS digest FROM documents LEFT JOIN lists USING (doc_id)""")
def tag_rules_long(spark, sf_dir):
    """Whole documents against a rule for each of many words, which Spark gathers from the documents."""
    docs = spread(C.table(spark, sf_dir, "documents")).select("doc_id", "text")
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))).alias("word"))
    words = found.distinct().where(F.col("word").rlike("^[a-z]{4,}$")).orderBy("word").limit(LONG_RULES)
    rules = words.select(F.col("word").alias("ord"), F.concat(F.lit(r"(?iU)\b"), "word", F.lit(r"\b")).alias("pattern"),
                         F.left("word", F.lit(3)).alias("tag"))
    tagged = S.tag_rules(docs, staged(rules, "rules"), always=None)
    return tagged.select("doc_id", F.size("tags").cast("bigint").alias("n_tags"), F.md5(F.array_join("tags", ",")).alias("digest"))


@query("extract_blocks", f"SELECT path, CAST(pos AS INTEGER) AS pos, original FROM {_EXPLODED}")
def extract_blocks(spark, sf_dir):
    return S.extract_blocks(programs(spark, sf_dir))


@query("extract_records", f"""
    SELECT path, CAST(unnest(range(1, len(r) + 1)) AS INTEGER) AS pos, unnest(r) AS original
    FROM (SELECT path, {_RECORDS} AS r FROM {C.PROGRAMS.sql} WHERE {_VSAM})""")
def extract_records(spark, sf_dir):
    return S.extract_records(programs(spark, sf_dir))


@query("substitute_blocks", f"""
    SELECT path, md5(array_to_string(list_transform(range(1, len(pieces) + 1), lambda i:
        pieces[i] || CASE WHEN i > len(b) THEN '' ELSE '{P.STUB_OPEN}' || chr(10) || '# Original: '
            || trim(split_part(b[i], chr(10), 1)) || '...' || chr(10) || 'call_' || md5(b[i]) || chr(10) || '{P.STUB_CLOSE}' END), ''))
        AS digest
    FROM (SELECT path, {_BLOCKS} AS b, string_split_regex(text, '{_re2(P.COMMAND_BLOCK)}') AS pieces FROM {C.PROGRAMS.sql})""")
def substitute_blocks(spark, sf_dir):
    corpus = programs(spark, sf_dir)
    originals = S.extract_blocks(corpus).select("original").distinct()
    translations = originals.withColumn("translated", F.concat(F.lit("call_"), F.md5("original")))
    enriched = S.substitute_blocks(corpus, translations)
    return enriched.select("path", F.md5("enriched").alias("digest"))


@query("census_commands", f"""
    SELECT category, command, operand, count(*) AS uses, CAST(sum(options) AS BIGINT) AS options
    FROM (SELECT CASE WHEN command = 'READ' THEN 'File control' WHEN command = 'RETURN' THEN 'Program control'
                      ELSE 'Temporary storage' END AS category, *
          FROM (SELECT upper(regexp_extract(original, '(?i)CICS\\s+(\\w+( +TS)?)', 1)) AS command,
                       regexp_extract(original, '(?i)(file|queue)\\(''([^'']*)''', 2) AS operand,
                       len(regexp_extract_all(original, '\\(')) AS options FROM {_EXPLODED}))
    GROUP BY ALL""")
def census_commands(spark, sf_dir):
    return S.census_commands(S.extract_blocks(programs(spark, sf_dir)), by=[])


def _census_sql():
    """Field table worked out from the part, not from its rendered copybook."""
    id_w, price_d, qty = "(4 + p_partkey % 6)", "(5 + p_size % 4 + 2)", "(1 + p_partkey % 18)"
    sizes, rows = "(1 + p_partkey % 4)", "(2 + p_size % 3)"
    price_w = f"({price_d} // 2 + 1)"
    qty_w = f"(CASE WHEN {qty} <= 4 THEN 2 WHEN {qty} <= 9 THEN 4 ELSE 8 END)"
    at_qty, at_sizes = f"{id_w} + {price_w}", f"{id_w} + {price_w} + {qty_w}"
    at_row = f"{at_sizes} + 3 * {sizes}"
    at_date = f"{at_row} + 12 * {rows}"
    fields = [
        ("PART-RECORD", "group", "1", "''", "0", "NULL"), ("PART-ID", "display", "1", "''", "0", id_w),
        ("PART-PRICE", "packed", "1", "''", id_w, price_w), ("PART-QTY", "binary", "1", "''", at_qty, qty_w),
        ("PART-SIZES", "display", sizes, "''", at_sizes, f"3 * {sizes}"), ("PART-ROW", "group", rows, "''", at_row, "NULL"),
        ("ROW-CODE", "display", "1", "''", at_row, "6"), ("ROW-PRICE", "packed", "1", "''", f"{at_row} + 6", "6"),
        ("PART-STAMP", "display", "1", "''", at_date, "9"), ("STAMP-PARTS", "group", "1", "'PART-STAMP'", at_date, "NULL"),
        ("STAMP-HIGH", "display", "1", "''", at_date, "6"), ("STAMP-LOW", "display", "1", "''", f"{at_date} + 6", "3"),
        ("PART-FLAG", "display", "1", "''", f"{at_date} + 9", "1"),
    ]
    return " UNION ALL ".join(
        f"SELECT CAST(p_partkey AS BIGINT) AS path, '{n}' AS name, '{u}' AS usage, CAST({o} AS INTEGER) AS occurs, "
        f"{r} AS redefines, CAST({at} AS INTEGER) AS \"offset\", CAST({w} AS INTEGER) AS width FROM part"
        for n, u, o, r, at, w in fields)


@query("layout_census", _census_sql())
def layout_census(spark, sf_dir):
    return S.layout_census(C.COPYBOOKS.df(spark, sf_dir)).select(
        "path", "name", "usage", "occurs", "redefines", "offset", "width")


@query("segment_summary", f"""
    SELECT path, CAST(len(b) AS INTEGER) AS cics_segments, CAST(r AS INTEGER) AS vsam_segments,
           CAST(len(b) + r AS INTEGER) AS segments, len(b) > 0 AS preamble, helpers
    FROM (SELECT path, {_BLOCKS} AS b, CASE WHEN {_VSAM} THEN len({_RECORDS}) ELSE 0 END AS r,
                 {_has(P.PACKED_USAGE)} AS helpers FROM {C.PROGRAMS.sql})""")
def segment_summary(spark, sf_dir):
    return S.segment_summary(programs(spark, sf_dir))
