"""Document fingerprints: bottom-k sketches of five-word shingles, with DataFrame functions alone.

A sketch is the sorted array of the ``k`` least distinct hashes of a text's shingles.  Sketches merge: the k least of two
sketches' hashes are the sketch of both texts' shingles together.  So a text is taken in parts of about ``PART`` code
points, cut between words, and a fold keeps the sketch so far and the hashes of the last words; no list is longer than a
part.  Of the k least hashes of two sets together, the share that both have estimates the resemblance; where a set has
fewer than k shingles the sketch is the set and nothing is estimated.

Words are what stands between ASCII blanks, lower-cased; a word's hash is Spark's ``xxhash64``, a shingle's the
``xxhash64`` of its words' hashes.  A text of fewer words is one shingle; a text without words has an empty sketch, which
is like another empty one and unlike all others.

Null texts are empty.  Null ids come after all others.  Texts of one id follow each other by their hash; rows equal in id
and text are one document, returned as often as it is there.  The document after the last is the first; a single
document follows itself.  An empty table gives an empty table.  Further columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonedeck.llm.frames import shuffle_width, staged

#: Hashes of a sketch, words of a shingle, code points of a part.
K, SHINGLE, PART = 128, 5, 1 << 15
#: Rows of a repeated document that are written out together.
COPIES = 10_000

_LONGS = "array<bigint>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return _least(F.concat(a, b), k)


def _shingle(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(size)])


def sketch(text: Column, k: int = K, shingle: int = SHINGLE, part: int = PART) -> Column:
    """The sketch of a text; null is empty."""
    text = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")

    def words(piece: Column) -> Column:
        return F.transform(F.filter(F.split(piece, " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - shingle)
        return F.when(F.size(own) >= shingle, F.transform(starts, lambda i: _shingle(own, i, shingle))).otherwise(
            F.array().cast(_LONGS))

    def step(held: Column, piece: Column) -> Column:
        # The last words of the parts before stand in front of this one's.
        return _let(F.concat(held["tail"], words(piece)), lambda own: F.struct(
            merge_sketches(held["least"], shingles(own), k).alias("least"),
            F.slice(own, F.greatest(F.lit(1), F.size(own) - (shingle - 2)), shingle - 1).alias("tail"),
            (held["n"] + F.size(own) - F.size(held["tail"])).alias("n")))

    # Each match ends where a word ends.
    pieces = F.when(F.char_length(text) <= part, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}[^ ]*"), F.lit(0)))
    start = F.struct(F.array().cast(_LONGS).alias("least"), F.array().cast(_LONGS).alias("tail"), F.lit(0).alias("n"))

    def finish(held: Column) -> Column:
        # All words of a short text are in the tail.
        whole = F.aggregate(held["tail"], F.lit(42).cast("bigint"), lambda h, w: F.xxhash64(h, w))
        return F.when(held["n"] >= shingle, held["least"]).when(held["n"] > 0, F.array(whole)).otherwise(
            F.array().cast(_LONGS))

    return F.aggregate(pieces, start, step, finish)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have, from their sketches; 0 to 1."""
    def shared(union: Column) -> Column:
        both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0))

    return _let(merge_sketches(a, b, k), shared)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of a text, from its sketch; exact below k."""
    span = F.get(a, F.lit(k - 1)).cast("double") + float(1 << 63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * float(1 << 64) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has too; 0 to 1, 1 for an empty first text."""
    alike = resemblance(a, b, k)
    both = alike / (alike + 1) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def sketch_text(a: Column) -> Column:
    """A sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_parts(parts: DataFrame, by: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``by, sketch``: the sketches of all rows of a key merged.

    The least hashes of each key and task go on as rows, so a key of any size costs every task at most k of them.
    """
    single = parts.select(by, F.explode(sketch_col).alias("h")).distinct()
    ranked = single.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("h"))).where(F.col("place") <= k)
    merged = ranked.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    return parts.select(by).distinct().join(merged, by, "left").select(
        by, F.coalesce("sketch", F.array().cast(_LONGS)).alias("sketch"))


# Which document comes next.

def _order(row: str = "") -> Column:
    at = f"{row}." if row else ""
    return F.struct(F.col(f"{at}doc_id").isNull().alias("no_id"), F.col(f"{at}doc_id").alias("doc_id"),
                    F.col(f"{at}key").alias("key"))


def _splitters(nodes: DataFrame) -> list:
    """The first document of each of a number of ranges of about equal size; one struct per range."""
    width = shuffle_width(nodes.sparkSession)
    ranges = nodes.select(_order().alias("at")).repartitionByRange(width, "at")
    rows = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min("at").alias("first")).collect()
    return sorted((r.first for r in rows), key=lambda f: (f.no_id, f.doc_id or 0, f.key))


def _literal(first) -> Column:
    return F.struct(F.lit(first.no_id).alias("no_id"), F.lit(first.doc_id).cast("bigint").alias("doc_id"),
                    F.lit(first.key).cast("bigint").alias("key"))


def _range_of(at: Column, firsts: list) -> Column:
    """Number of the range that a document falls into: every so many ranges are tried, then those between two of them."""
    step = max(1, round(len(firsts) ** 0.5))
    chunks = [firsts[i:i + step] for i in range(0, len(firsts), step)]
    coarse = F.array(*[_literal(c[0]) for c in chunks])
    fine = F.array(*[F.array(*[_literal(f) for f in c]) for c in chunks])
    count = lambda tried: F.size(F.filter(tried, lambda f: f <= at))
    return _let(count(coarse) - 1, lambda c: c * step + count(F.get(fine, c)) - 1)


def with_next(docs: DataFrame, nodes: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """All rows of ``doc_id, key, text``, columns computed from them, and a struct ``next`` of the next document's
    ``text`` and computed columns.

    The rows must differ; ``nodes`` has their ``doc_id, key``.  Each moves once, to the range of ids it falls into; the first document of a range is sent to
    the range before as well, so that every row finds its next one at hand.
    """
    firsts = _splitters(nodes)
    names = ["text", *carried]
    if not firsts:
        return docs.select("*", *[c.alias(n) for n, c in carried.items()]).withColumn("next", F.struct(*names))
    spark = docs.sparkSession
    at = _order()
    before = [(f.no_id, f.doc_id, f.key, (i - 1) % len(firsts)) for i, f in enumerate(firsts)]
    # One row for each range, of numbers only.
    guests = F.broadcast(spark.createDataFrame(before, "no_id boolean, doc_id bigint, key bigint, range int"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.key") == F.col("g.key"))
    guest = docs.alias("d").join(guests.alias("g"), same).select("d.*", "g.range").withColumn("guest", F.lit(True))
    own = docs.withColumn("range", _range_of(at, firsts)).withColumn("guest", F.lit(False))
    both = own.unionByName(guest).select("*", *[c.alias(n) for n, c in carried.items()])
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").isNull(), "doc_id", "key")
    return both.withColumn("next", F.lead(F.struct(*names)).over(order)).where(~F.col("guest")).drop("range", "guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many code points of the start of the following text, or all."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.left(text, F.char_length(text) - quarter), F.left(following, quarter))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                          shingle: int = SHINGLE) -> DataFrame:
    """For every row ``doc_id, n_chars``, its text edited with the next document's start, and both sketches.

    Columns: ``doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next, in_edited, n_shingles``;
    ``in_edited`` is the containment of the text's shingles in the edited text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    counts = staged(rows.groupBy("doc_id", "key").agg(F.count("*").alias("rows")), "fingerprint-documents")
    repeated = counts.where(F.col("rows") > 1)
    again = bool(repeated.take(1))
    if again:  # equal rows are fingerprinted once
        rows = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    found = with_next(rows, counts, {"sketch": sketch(F.col("text"), k, shingle)})
    found = found.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    found = found.select("doc_id", "key", F.char_length("text").cast("bigint").alias("n_chars"),
                         F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sketch",
                         sketch(F.col("edited"), k, shingle).alias("edited_sketch"),
                         F.col("next.sketch").alias("next_sketch"))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    found = found.select("doc_id", "key", "n_chars", "edited_sha256", "sketch", "edited_sketch",
                         resemblance(own, other, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
                         containment(own, other, k).alias("in_edited"), distinct_shingles(own, k).alias("n_shingles"))
    if again:
        more = repeated.select("doc_id", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(
            (F.col("rows") - 1) / COPIES))).alias("chunk"), "rows")
        size = F.least(F.lit(COPIES), F.col("rows") - F.col("chunk") * COPIES).cast("int")
        more = more.repartition("doc_id", "key", "chunk").select(
            F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.explode(F.array_repeat(F.lit(1), size)).alias("_one"))
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
        single = found.join(repeated.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")), same, "left_anti")
        found = single.unionByName(found.join(more, same).drop("_doc", "_key", "_one"))
    return found.drop("key")
