"""How far the sources of a language differ in the words they use, over a k-squared quadtree of the group-term matrix.

A group is a pair of language and source, a term a run of ASCII letters or non-ASCII characters, A-Z lower-cased.  Each
language keeps the terms of at least ``MIN_DOCS`` of its documents.  Every group prices every kept term of its language
in parts of 10^9, five occurrences added to each; two groups lie apart by the sum of their differences over all terms.

The matrix of groups and terms is mostly empty for rare terms, so it is held as a quadtree.  Its upper part is the
keys of a shuffle: blocks of terms by pairs of blocks of 2^``SIDE_BITS`` groups, of which one task holds two squares
at a time.  Below, a square halves into quadrants, kept as one bit each per level.  Two blocks of groups are walked
down jointly: where both quadrants are all zero, every pair of their groups differs by the same amount in every column,
which is priced by multiplication; the others are halved on, and leaves are compared number by number.

Null texts, languages and sources are empty strings.  Groups without terms, with empty or very long texts, and repeated
rows count like others; a text is read in pieces of ``PIECE`` bytes.  A language without kept terms has pairs of
distance zero and no term rows; one with a single source has no pairs.  Ties rank by the item's UTF-8 bytes.  An empty
table gives an empty table.  Further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonedeck.llm.frames import discard, staged

#: Documents of a language that a term must occur in, occurrences added, parts of the whole, terms reported of a group.
MIN_DOCS, ADDED, PARTS, TOP = 30, 5, 1_000_000_000, 50
#: Side of a square and of a leaf, as powers of two.
SIDE_BITS, LEAF_BITS = 8, 3
#: Bytes of a text that are split together, distinct terms that a task counts before it passes them on.
PIECE, HELD = 4 << 20, 400_000

#: Bytes of a term stay, A-Z as a-z; all others become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PIECE`` bytes, cut between terms."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, added up as far as ``HELD`` allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, docs) in held.items():
            names = list(terms)
            for i in range(0, len(names), 1 << 16):
                part = names[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()),
                     pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(2)], batch.column(2).cast(pa.binary()))
        for lang, source, text in rows:
            terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in term_pieces(text.as_py()):
                terms.update(piece)
                seen.update(piece)
            docs.update(seen)
        if sum(len(terms) for terms, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` over all of ``lang, source, text``."""
    counted = docs.select("lang", "source", "text").mapInArrow(
        _count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + ADDED) / (total + ADDED * terms)), exactly; null without terms."""
    kind = "decimal(19,0)"
    over, under = (n + ADDED).cast(kind) * F.lit(PARTS).cast("decimal(10,0)"), (total + ADDED * terms).cast(kind)
    return F.when(under > 0, F.call_function("div", over, under) + 1)


class Square:
    """A square of the matrix: prices of up to 2^``bits`` groups and terms, and which cells are not zero, level by level.

    ``levels[k]`` has one flag for each quadrant of side 2^k.
    """

    def __init__(self, rest: np.ndarray, rows: np.ndarray, columns: np.ndarray, prices: np.ndarray, bits: int = SIDE_BITS):
        side = 1 << bits
        self.n_rows, self.bits = len(rest), bits
        self.rest = np.pad(rest, (0, side - len(rest)))
        self.prices = np.repeat(self.rest[:, None], side, axis=1)
        self.prices[rows, columns] = prices
        flags = np.zeros((side, side), bool)
        flags[rows, columns] = True
        self.levels = [flags]
        while len(flags) > 1:
            flags = flags.reshape(len(flags) // 2, 2, -1, 2).any(axis=(1, 3))
            self.levels.append(flags)


def walk_jointly(a: Square, b: Square, columns: int, leaf_bits: int = LEAF_BITS) -> np.ndarray:
    """Sum over the first ``columns`` columns of the price differences of each row of ``a`` to each row of ``b``.

    Of a square with itself only the part above the diagonal is walked.
    """
    whole, leaf = 1 << a.bits, 1 << leaf_bits
    out = np.zeros((whole, whole), np.int64)
    quads = np.zeros((1, 3), np.int64)  # row of quadrants in a, in b, column of quadrants
    for level in range(a.bits, leaf_bits - 1, -1):
        side, n = 1 << level, whole >> level
        quads = quads[(quads[:, 0] * side < a.n_rows) & (quads[:, 1] * side < b.n_rows) & (quads[:, 2] * side < columns)]
        if a is b:
            quads = quads[quads[:, 0] <= quads[:, 1]]
        filled = a.levels[level][quads[:, 0], quads[:, 2]] | b.levels[level][quads[:, 1], quads[:, 2]]
        zero, quads = quads[~filled], quads[filled]
        # Columns that a pair of quadrant rows holds in zero quadrants of this level; their price is one product.
        width = np.zeros((n, n), np.int64)
        np.add.at(width, (zero[:, 0], zero[:, 1]), np.minimum(side, columns - zero[:, 2] * side))
        for r, s in zip(*np.nonzero(width)):
            rows, others = slice(r * side, (r + 1) * side), slice(s * side, (s + 1) * side)
            out[rows, others] += width[r, s] * np.abs(a.rest[rows, None] - b.rest[None, others])
        if level > leaf_bits:
            halves = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)])
            quads = (2 * quads[:, None, :] + halves[None]).reshape(-1, 3)
    inside = np.arange(whole) < columns
    for r, s, c in quads:
        at = slice(c * leaf, (c + 1) * leaf)
        rows, others = slice(r * leaf, (r + 1) * leaf), slice(s * leaf, (s + 1) * leaf)
        gaps = np.abs(a.prices[rows, None, at] - b.prices[None, others, at])
        out[rows, others] += gaps[:, :, inside[at]].sum(axis=2)
    return out


def _square_pairs(key: tuple, cells: pd.DataFrame, bits: int, leaf_bits: int) -> pd.DataFrame:
    """``lang, a, b, apart, columns`` for the pairs of groups of one key ``lang, block, i, j``, over the block's terms.

    A row without a term says what a group pays for terms that it lacks.
    """
    lang, _, i, j = key
    side = 1 << bits
    known = cells[cells["term"].notna()]
    codes, names = pd.factorize(known["term"])
    rows, prices = known["g"].to_numpy(), known["price"].to_numpy()
    rest = {}
    for part in {i, j}:
        groups = cells[cells["term"].isna() & (cells["g"] // side == part)].sort_values("g")
        rest[part] = groups["price"].to_numpy()
    apart = np.zeros((side, side), np.int64)
    for first in range(0, len(names), side):  # a block has a little less than one side terms; a fuller one takes two squares
        squares = {}
        for part in rest:
            mine = (rows // side == part) & (codes // side == first // side)
            squares[part] = Square(rest[part], rows[mine] % side, codes[mine] % side, prices[mine], bits)
        apart += walk_jointly(squares[i], squares[j], min(side, len(names) - first), leaf_bits)
    a, b = np.meshgrid(np.arange(len(rest[i])) + i * side, np.arange(len(rest[j])) + j * side, indexing="ij")
    a, b = a[a < b], b[a < b]
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "apart": apart[a % side, b % side], "columns": len(names)})


def _pairs_apart(cells: DataFrame, groups: DataFrame, bits: int, leaf_bits: int) -> DataFrame:
    """``lang, a, b, apart``: the distance of every two groups of a language, ``a < b`` by number."""
    wide = cells.select("lang", "g", "groups", "term", "price",
                        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    bare = groups.select("lang", "g", "groups", F.lit(None).cast("string").alias("term"), F.col("rest").alias("price"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    side = 1 << bits
    own = F.floor(F.col("g") / side)
    spread = wide.unionByName(bare).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("groups") - 1) / side))))
    keyed = spread.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                          "g", "term", "price")
    return keyed.groupBy("lang", "block", "i", "j").applyInPandas(
        lambda key, part: _square_pairs(key, part, bits, leaf_bits), "lang string, a bigint, b bigint, apart bigint, columns bigint").groupBy("lang", "a", "b").agg(
        F.sum("apart").alias("apart"), F.sum("columns").alias("columns"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  min_docs: int = MIN_DOCS, top: int = TOP, side_bits: int = SIDE_BITS, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms a source prefers.

    Part ``pair`` has all other sources of the language by falling distance; part ``term`` the first ``top`` terms that
    the group prices above its language.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts = staged(term_counts(docs), "divergence-counts")
    vocabulary = staged(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(
        F.col("docs") >= min_docs).drop("docs"), "divergence-vocabulary")
    kept = staged(counts.drop("docs").join(vocabulary, ["lang", "term"]), "divergence-kept")
    discard(counts)
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"]).withColumns({
        "g": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"),
        "groups": F.count("*").over(Window.partitionBy("lang")),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / max(1, (3 << side_bits) // 4))),
        "rest": F.coalesce(price(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")), F.lit(0).cast("bigint"))})
    groups = staged(groups, "divergence-groups")
    cells = kept.join(groups, ["lang", "source"]).withColumn("price", price(F.col("n"), F.col("total"), F.col("terms")))
    apart = _pairs_apart(cells, groups, side_bits, leaf_bits)
    side = lambda c: groups.select("lang", F.col("g").alias(c), F.col("source").alias(f"source_{c}"),
                                   F.col("rest").alias(f"rest_{c}"), F.col("terms").alias(f"terms_{c}"))
    # Terms of blocks that neither group has a square for are priced like any other zero quadrant.
    value = F.col("apart") + (F.col("terms_a") - F.col("columns")) * F.abs(F.col("rest_a") - F.col("rest_b"))
    found = staged(apart.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).select(
        "lang", "source_a", "source_b", value.alias("value")), "divergence-pairs")
    both = found.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(
        found.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    own = cells.withColumn("value", F.col("price") - price(F.col("in_lang"), F.col("lang_total"), F.col("terms")))
    own = own.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = both.withColumn("rank", order).withColumn("part", F.lit("pair"))
    terms = own.withColumn("rank", order).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))
