"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions alone.

Lines with a word are linked if they are equal, or if both have at least ``NEAR_CHARS`` code points and at most two
insertions, deletions or substitutions of a code point turn one into the other.  Linked lines form classes; the first line
of a class, by document id and place, stays and the others go.

A line is cut into threshold-plus-one, that is three, segments.  Two lines within the threshold share a segment at a place
that their span of lengths gives, up to a shift of one for the middle one, so a line has its own segments as keys and what
it looks for in lines up to two shorter, four to eight keys in all.  Of a key of two rows the pair follows from its counts;
the few keys of more rows are looked for again.  A segment shared by more than ``HOT`` rows is not paired up: its lines get
five keys of the segment and a part each of their letters' signature, one of which near lines share.  Where such a key is
shared by many too, its lines move on to keys of all but two of six blocks, and from there to parts of these two blocks,
until a block has ``LEAF`` code points.  There lines are indexed by what is left of the blocks without the edits: all lines
of such a key are linked to one of them, so that no step pairs all rows of a large key.  Where rows of a key meet, pairs
whose lengths or counts of letters differ in more than two edits can make are dropped, and so are those with more edits in
what their key leaves open, the line or the blocks.  Pairs of which more than two of eight parts are not found again near
their place are dropped before all that is left is verified by a banded bit-parallel automaton, whose state holds one bit
for each diagonal and number of errors.

Nulls and texts without words have no lines.  Very long texts and lines are treated like others: a line is a string of its
own, and a text is put together from what stands between removed lines.  Null ids come last in the order.  Rows equal in id
and text count as one document; otherwise repeated ids are documents of their own.  An empty table gives an empty table.
Other columns pass through; where one has the name of an output, the output gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.llm.components import connected_components
from zonedeck.llm.frames import discard, free_name, staged

#: Edit threshold (the keys of crowded segments are made for two), least length of lines that match other than exactly.
ERRORS, NEAR_CHARS = 2, 20
#: Lengths that share their cuts: so many, and so many from ``LONG`` code points on (a multiple of both).
SPANS, LONG = (8, 32), 128
#: Parts of a line of which all but ``ERRORS`` have to be found in another one before the two are compared.
PARTS = 8
#: Rows of a key that are paired up, code points of a block that is not cut further.
HOT, LEAF = 32, 8
#: Letters whose counts tell pairs apart before they are compared.
LETTERS = "etaoinsrhldcumpgbfvwyk. 0123456789"


def within(a: Column, b: Column, errors: int = ERRORS) -> Column:
    """Whether two arrays of characters are at most ``errors`` edits apart.

    ``reach[e]`` has bit d set if all characters of ``a`` so far and as many of ``b``, shifted by d - errors, are
    matched with e errors.
    """
    width = (1 << 2 * errors + 1) - 1
    one = lambda bit: F.lit(bit).cast("bigint")

    def spread(first: list[Column]) -> Column:
        """Allow characters of ``b`` to be skipped, each for one more error."""
        out = [first[0]]
        for e in range(1, errors + 1):
            out.append(first[e].bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(one(width)))
        return F.array(*out)

    def step(reach: Column, i: Column) -> Column:
        same = one(0)
        for d in range(2 * errors + 1):
            same = same + F.when(F.get(a, i) == F.get(b, i + (d - errors)), one(1 << d)).otherwise(one(0))
        # F.array makes a value of it, so that the comparison is made once.
        def moves(m: Column) -> Column:
            first = [F.get(reach, F.lit(0)).bitwiseAND(m)]
            for e in range(1, errors + 1):
                fewer = F.get(reach, F.lit(e - 1))
                first.append(F.get(reach, F.lit(e)).bitwiseAND(m).bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)))
            return spread(first)

        return F.get(F.transform(F.array(same), moves), F.lit(0))

    start = spread([one(1 << errors)] + [one(0)] * errors)
    last = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step)
    off = (F.size(b) - F.size(a) + errors).cast("int")
    # The diagonal on which both end.
    end = F.coalesce(F.get(F.array(*[one(1 << d) for d in range(2 * errors + 1)]), off), one(0))
    return F.exists(last, lambda reach: reach.bitwiseAND(end) > 0)


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, line_no, line`` of all lines with a word; ``key`` is the hash of id and text."""
    doc, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias(
        "line_no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _tail(text: Column, at: Column) -> Column:
    """All from the zero-based place on."""
    return F.substring(text, at + 1, F.lit(1 << 30))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _base(n: Column) -> Column:
    """The least length of the span of a length."""
    short, long = SPANS
    return (n - F.when(n < LONG, n % short).otherwise(n % long)).cast("int")


def _segment_keys(lines: DataFrame) -> DataFrame:
    """``key, id, n``: the segments of each line, and what it looks for in lines up to two shorter.

    Lengths in one span have the same cuts: the first two segments count from the start, the last one from the end.  If
    both outer segments have an edit, the middle one lies in the longer line where it is or one place later; of two lines
    of one length, one has it so.  The least two lengths of a span also have the keys of the span before.
    """
    n, line, base = F.col("n"), F.col("line"), F.col("base")
    here = _base(n)
    bases = F.when(n - here < ERRORS, F.array(here, _base(here - 1))).otherwise(F.array(here))
    cut = lambda k: F.floor(base * k / (ERRORS + 1)).cast("int")
    parts = [(0, _cut(line, cut(0), cut(1))), (1, _cut(line, cut(1), cut(2))), (1, _cut(line, cut(1) + 1, cut(2) + 1)),
             (2, F.right(line, cut(3) - cut(2)))]
    # Plain numbers: an array of structs makes this step three times as slow.
    keys = F.array(*[F.xxhash64("base", F.lit(segment), part) for segment, part in parts])
    return lines.select("id", "n", "line", F.explode(bases).alias("base")).select(F.explode(keys).alias("key"), "id", "n")


def _sign_keys(found: DataFrame) -> DataFrame:
    """``key, id, n, sign``: the keys of rows, each with every one of the signature's parts.

    Two lines within the threshold differ in no more bits than there are parts but one, so that some part is equal.
    """
    parts = 2 * ERRORS + 1
    masks = [sum(1 << k for k in range(i, len(LETTERS), parts)) for i in range(parts)]
    return found.select("id", "n", "sign", "p", F.explode(F.array(*[F.xxhash64(
        "key", F.lit(i), F.col("sign").bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(masks)])).alias("key"))


#: How the two blocks that hold the edits lie: how much longer the probing line is, blocks x < y, shift between them.
#: Both edits in one block, or in neighbours, need no shift; otherwise each block has one edit.
_SPLITS = [(d, x, y, s) for d in range(3) for x in range(6) for y in range(x + 1, 6)
           for s in ((0,) if y == x + 1 else ((0, 1, -1), (0, 1), (1,))[d])]


def _block_keys(rows: DataFrame, payload: bool) -> DataFrame:
    """Keys of all but two blocks (or of all but two parts of two blocks) of each row, with the blocks if asked for.

    A row has ``p`` and, beside it, ``q``, the blocks in which a line may differ from lines of the same ``key``; ``a``
    and ``b`` are their lengths in the lines that are probed.  Without ``q``, ``p`` has up to two edits; with it, both have
    at most one.
    """
    key, own, p, q, a, b = (F.col(c) for c in ("key", "own", "p", "q", "a", "b"))

    def made(key, own, p, q, a, b):
        fields = [key.alias("key"), own.alias("own")]
        if payload:
            fields += [p.alias("p"), q.alias("q"), a.cast("int").alias("a"), b.cast("int").alias("b")]
        return F.struct(*fields)

    longer = F.char_length(p) - a

    def one(x):
        c = lambda k: F.floor(a * k / 6).cast("int")
        near = x["y"] == x["x"] + 1
        start, after = c(x["x"]), c(x["y"] + 1) + longer
        end = F.when(near, after).otherwise(c(x["x"] + 1) + x["s"])
        again = F.when(near, after).otherwise(c(x["y"]) + x["s"])
        return made(F.xxhash64(key, a, x["x"], x["y"], F.left(p, start), _cut(p, end, again), _tail(p, after)),
                    own & (x["s"] == 0), _cut(p, start, end), F.when(~near, _cut(p, again, after)),
                    F.when(near, c(x["y"] + 1) - start).otherwise(c(x["x"] + 1) - start),
                    F.when(near, F.lit(0)).otherwise(c(x["y"] + 1) - c(x["y"])))

    def two(x):
        third = lambda n, k: F.floor(n * k / 3).cast("int")
        low, high = third(a, x["i"]), third(a, x["i"] + 1)
        low_q, high_q = third(b, x["j"]), third(b, x["j"] + 1)
        end, end_q = high + longer, high_q + F.char_length(q) - b
        return made(F.xxhash64(key, a, b, x["i"], x["j"], F.left(p, low), _tail(p, end), F.left(q, low_q), _tail(q, end_q)),
                    own, _cut(p, low, end), _cut(q, low_q, end_q), high - low, high_q - low_q)

    literal = lambda names, values: F.array(*[F.struct(*[
        F.lit(v).alias(n) for n, v in zip(names, row)]) for row in values])
    splits = F.filter(literal(("d", "x", "y", "s"), _SPLITS), lambda x: x["d"] == longer)
    parts = literal(("i", "j"), [(i, j) for i in range(3) for j in range(3)])
    keys = F.when(q.isNull(), F.transform(splits, one)).otherwise(F.transform(parts, two))
    return rows.select("id", "n", "sign", F.inline(keys))


def _leaf_keys(rows: DataFrame) -> DataFrame:
    """``key, id, own``: what is left of the short blocks of a row without two edits.

    All lines of a key are within two edits of each of its own ones: both leave out the same places, or one has what the
    other leaves out.
    """
    key, own, p, q, a, b = (F.col(c) for c in ("key", "own", "p", "q", "a", "b"))
    places = lambda t: F.sequence(F.lit(0), F.char_length(t) - 1)
    without = lambda t: F.transform(places(t), lambda i: F.concat(F.left(t, i), _tail(t, i + 1)))
    masked = lambda t: F.transform(places(t), lambda i: F.concat(
        i.cast("string"), F.lit(":"), F.left(t, i), _tail(t, i + 1)))
    whole = lambda t: F.array(t)

    def hashed(tag: int, first: Column, second) -> Column:
        return F.flatten(F.transform(first, lambda x: F.transform(second(x), lambda y: F.xxhash64(key, F.lit(tag), x, y))))

    blank = lambda x: F.array(F.lit(""))
    # One block: two substitutions; an insertion and a deletion; a line one longer; a line two longer.
    twice = F.flatten(F.transform(places(p), lambda i: F.transform(
        F.filter(places(p), lambda j: j > i), lambda j: F.xxhash64(
            key, F.lit(0), i, j, F.left(p, i), _cut(p, i + 1, j), _tail(p, j + 1)))))
    one_own = F.concat(twice, hashed(1, without(p), blank), hashed(2, masked(p), blank), hashed(3, whole(p), blank))
    one = (F.when(own, one_own).when(F.char_length(p) == a + 1, hashed(2, F.flatten(F.transform(without(p), masked)), blank))
           .otherwise(hashed(3, F.flatten(F.transform(without(p), without)), blank)))
    # Two blocks with an edit each, by how much longer the probing line is in either.
    kinds = [(0, 0), (1, -1), (-1, 1), (1, 0), (0, 1), (1, 1)]
    mine = {1: whole, 0: masked, -1: without}
    theirs = {1: without, 0: masked, -1: whole}
    two_own = F.concat(*[hashed(4 + k, mine[s](p), lambda _, t=t: mine[t](q)) for k, (s, t) in enumerate(kinds)])
    two = F.when(own, two_own)
    for k, (s, t) in enumerate(kinds[1:], 1):
        fits = (F.char_length(p) == a + s) & (F.char_length(q) == b + t)
        two = two.when(fits, hashed(4 + k, theirs[s](p), lambda _, t=t: theirs[t](q)))
    keys = F.array_distinct(F.when(q.isNull(), one).otherwise(two))
    return rows.select("id", "own", F.explode(keys).alias("key"))


def _met(keys: DataFrame, purpose: str) -> DataFrame:
    """``key, rows, u, v, least`` of the keys at which something meets: number of rows, first and last id, first own id."""
    return staged(keys.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("id").alias("u"), F.max("id").alias("v"),
        F.min(F.when(F.col("own"), F.col("id"))).alias("least")).where("rows > 1 and least is not null and u < v"), purpose)


def _shared(keys: DataFrame, purpose: str) -> DataFrame:
    """``key, rows, u, v`` of the keys of several lines (``key, id, n``): number of rows, first and last id.

    Two rows count only if their lengths allow two edits.
    """
    return staged(keys.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("id").alias("u"), F.max("id").alias("v"), F.min("n").alias("low"),
        F.max("n").alias("high")).where(f"u < v and (rows > 2 or high - low <= {ERRORS})").select("key", "rows", "u", "v"),
        purpose)


def _sign(line: Column) -> Column:
    """A bit for each letter: whether it is there an odd number of times."""
    odd = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(1))
    sign = F.lit(0).cast("bigint")
    for k, c in enumerate(LETTERS):
        sign = sign.bitwiseOR(F.shiftleft(odd(c).cast("bigint"), k))
    return sign


def _pairs(found: DataFrame) -> DataFrame:
    """``u, v`` of rows of a key (``key, id, n, sign, p`` and maybe ``q``) with at most two edits in ``p`` and ``q``.

    Only there may rows of a key differ: two edits in ``p`` alone, or one each in ``p`` and ``q``.  Lengths and letters
    are compared first; an edit changes whether a letter is there an odd number of times for at most two letters.
    """
    columns = [c for c in ("key", "id", "n", "sign", "p", "q") if c in found.columns]
    found = found.select(*columns)
    other = found.toDF("key", "v", *[f"{c}_v" for c in columns[2:]])
    alike = (F.abs(F.col("n") - F.col("n_v")) <= ERRORS) & (
        F.bit_count(F.col("sign").bitwiseXOR(F.col("sign_v"))) <= 2 * ERRORS)
    edits = lambda c, most: F.levenshtein(c, f"{c}_v", most) >= 0
    near = edits("p", ERRORS)
    if "q" in columns:
        near = F.when(F.col("q").isNull(), near).otherwise(edits("p", 1) & edits("q", 1))
    alike = alike & near
    return found.withColumnRenamed("id", "u").join(other, "key").where((F.col("u") < F.col("v")) & alike).select("u", "v")


def _picked(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines that have one of the ids, by bitmaps of ids: a bit of a broadcast for each line, and no line is moved."""
    bucket, place = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    bits = ids.select(bucket.alias("bucket"), place.alias("place")).repartition("bucket").groupBy("bucket").agg(
        F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place % 8 + 1).cast("int"))) > 0
    return lines.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").where(there).select(*lines.columns)


def _parts_found(a: Column, b: Column) -> Column:
    """Whether all but ``ERRORS`` parts of one line occur in the other, no further off than so many edits can move them."""
    n, found = F.char_length(a), F.lit(0)
    for k in range(PARTS):
        start, end = (F.floor(n * x / PARTS).cast("int") for x in (k, k + 1))
        low = F.greatest(start - ERRORS, F.lit(0))
        found = found + (F.instr(_cut(b, low, end + ERRORS), _cut(a, start, end)) > 0).cast("int")
    return found >= PARTS - ERRORS


def _crowded_pairs(lines: DataFrame) -> list[DataFrame]:
    """Pairs among lines that share crowded segments: narrower blocks round by round, links to one line at the end."""
    out, table = [], None
    rows = lines.select(F.lit(0).cast("bigint").alias("key"), "id", F.explode(F.array(*map(F.lit, range(3)))).alias("d"),
                        F.col("line").alias("p"), F.lit(None).cast("string").alias("q"), "n", "sign").select(
        "key", "id", "n", "sign", (F.col("d") == 0).alias("own"), "p", "q", (F.col("n") - F.col("d")).alias("a"), F.lit(0).alias("b"))
    while True:
        met = _met(_block_keys(rows, False), "lines-met")
        found = staged(_block_keys(rows, True).join(met.select("key", "rows"), "key"), "lines-crowded")
        out.append(staged(_pairs(found.where(F.col("rows") <= HOT)), "lines-pairs"))
        discard(met, *([] if table is None else [table]))
        crowded = found.where(F.col("rows") > HOT).drop("rows")
        short = F.when(F.col("q").isNull(), F.col("a") <= 2 * LEAF).otherwise((F.col("a") <= LEAF) & (F.col("b") <= LEAF))
        if crowded.where(short).take(1):
            leaves = _leaf_keys(crowded.where(short))
            met = _met(leaves, "lines-met")
            linked = leaves.join(met.where("rows > 2").select("key", "least"), "key").where("id <> least").select(
                F.least("id", "least").alias("u"), F.greatest("id", "least").alias("v"))
            out.append(staged(linked.unionByName(met.where("rows = 2").select("u", "v")).distinct(), "lines-pairs"))
            discard(met)
        table, rows = found, crowded.where(~short)
        if not rows.take(1):
            discard(table)
            return out


def near_pairs(lines: DataFrame) -> DataFrame:
    """``u, v`` for pairs of distinct lines (``id, line, n``) within two edits.

    Every two lines within two edits are in one component of these pairs; of a crowded key not all pairs are given.
    """
    keys = _segment_keys(lines)
    met = _shared(keys, "lines-met")
    # Two rows are their key's first and last one; only the few keys of more are looked for again.
    more = staged(met.where("rows > 2").select("key", "rows"), "lines-more")
    found = staged(keys.join(more, "key"), "lines-keys")
    two = met.where("rows = 2").select("u", "v").distinct()
    # Only lines that meet another need their texts.
    ids = two.select(F.explode(F.array("u", "v")).alias("id")).unionByName(found.select("id")).distinct()
    texts = staged(_picked(lines, ids), "lines-texts")
    signed = staged(found.join(texts.drop("n"), "id").select(
        "key", "id", "n", "rows", _sign(F.col("line")).alias("sign"), F.col("line").alias("p")), "lines-keys")
    parts = [staged(two.unionByName(_pairs(signed.where(F.col("rows") <= HOT))).distinct(), "lines-pairs")]
    discard(met, more, found)
    many = signed.where(F.col("rows") > HOT).drop("rows")
    if many.take(1):
        keys = _sign_keys(many)
        met = _shared(keys, "lines-met")
        split = staged(keys.join(met.select("key", "rows"), "key"), "lines-crowds")
        parts.append(staged(_pairs(split.where(F.col("rows") <= HOT)), "lines-pairs"))
        left = split.where(F.col("rows") > HOT).select("id", "sign").distinct()
        if left.take(1):
            crowded = staged(texts.join(left, "id"), "lines-crowd")
            parts += _crowded_pairs(crowded)
            discard(crowded)
        discard(met, split)
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs if len(parts) == 1 else pairs.distinct()
    side = lambda i, c: texts.select(F.col("id").alias(i), F.col("line").alias(c))
    characters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)).alias(c)
    close = staged(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(_parts_found(F.col("a"), F.col("b"))).select(
        "u", "v", characters("a"), characters("b")), "lines-close")
    checked = staged(close.where(within(F.col("a"), F.col("b"))).select("u", "v"), "lines-near")
    discard(signed, texts, close, *parts)
    return checked


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines (``doc_id, key, line_no, hash``) and, by ``hash``, the first line of its class.

    The classes' columns are ``hash, first, first_hash``; ``first`` orders lines by id, document and place.
    """
    hash_ = F.substring(F.unhex(F.sha2("line", 256)), 1, 16)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line_no")
    exploded = _exploded(docs, id_col, text_col).withColumn("hash", hash_)
    thin = staged(exploded.select("doc_id", "key", "line_no", "hash"), "lines-all")
    distinct = staged(exploded.groupBy("hash").agg(F.min(place).alias("first"), F.first("line").alias("line")).withColumn(
        "id", F.monotonically_increasing_id()).withColumn("n", F.char_length("line")), "lines-distinct")
    near = distinct.where(F.col("n") >= NEAR_CHARS).select("id", "line", "n")
    roots = connected_components(near_pairs(near), "lines-components")
    named = distinct.select("hash", "first", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    named = staged(named.select("hash", "first", "root"), "lines-named")
    discard(distinct)
    least = staged(named.groupBy("root").agg(F.min(F.struct("first", "hash")).alias("least")), "lines-least")
    return thin, named.join(least, "root").select(
        "hash", F.col("least.first").alias("first"), F.col("least.hash").alias("first_hash"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept",
                counts: tuple[str, str, str] = ("n_lines", "n_removed", "n_near")) -> DataFrame:
    """All rows and columns, with the text that is left, the number of lines with a word, of lines removed, and of those
    that were not equal to the line that stays.

    Lines without a word stay.  The text of a row that loses nothing, and null, stay as they are.
    """
    out, counts = free_name(docs, out), tuple(free_name(docs, c) for c in counts)
    thin, classes = line_classes(docs, id_col, text_col)
    classes = staged(classes, "lines-classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line_no")
    drop = F.col("first") != place
    flags = thin.join(classes, "hash").select("key", "doc_id", F.struct(
        "line_no", drop.alias("drop"), (drop & (F.col("hash") != F.col("first_hash"))).alias("near")).alias("flag"))
    key, own, flag, lost = (free_name(docs, c) for c in ("_key", "_doc", "_flags", "_lost"))
    flags = staged(flags.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set("flag")).alias(flag)), "lines-flags")
    flags = flags.withColumnRenamed("doc_id", own).withColumnRenamed("key", key + "_")
    doc, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    joined = docs.withColumn(key, F.xxhash64(doc, text)).join(
        flags, (F.col(key) == F.col(key + "_")) & doc.eqNullSafe(F.col(own)), "left").drop(key, key + "_", own)
    gone = F.filter(flag, lambda f: f["drop"])
    parts, bounds = free_name(docs, "_parts"), free_name(docs, "_bounds")
    joined = joined.withColumn(lost, F.when(F.size(gone) > 0, F.transform(gone, lambda f: f["line_no"])))
    joined = joined.withColumn(parts, F.when(F.col(lost).isNotNull(), F.split(text, "\n", -1)))
    # What stands between removed lines, cut out in one go.
    joined = joined.withColumn(bounds, F.concat(F.array(F.lit(-1)), F.col(lost), F.array(F.size(parts))))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda j: F.slice(
        parts, F.get(bounds, j - 1) + 2, F.get(bounds, j) - F.get(bounds, j - 1) - 1))), "\n")
    size = lambda a: F.coalesce(F.when(F.col(flag).isNotNull(), F.size(a)), F.lit(0)).cast("bigint")
    return joined.select(*docs.columns, F.when(F.col(lost).isNotNull(), kept).otherwise(text).alias(out),
                         size(F.col(flag)).alias(counts[0]), size(gone).alias(counts[1]),
                         size(F.filter(flag, lambda f: f["near"])).alias(counts[2]))
