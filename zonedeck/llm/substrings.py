"""Removal of long repeated passages, found by recompression.

Words become symbols.  Each round first names runs of one symbol and then pairs: a hash of symbol and round puts every
symbol on the left or the right side, and a left symbol followed by a right one becomes their pair.  Names are hashes of
what they stand for, so all tasks name alike without a shuffle, and equal passages get equal symbols except near their
ends.  Pairs beyond ``SYMBOL_WORDS`` words are not made, which keeps symbols short enough to lie inside a window.

Every symbol carries the words that its making depended on.  A window of words contains a symbol for certain if it
contains all of those; this holds at each of the window's occurrences alike.  Of the symbols so contained the one of
least hash is the window's anchor, and a window without any takes the hash of its words.  Neighbouring windows of one
anchor form a stretch, about one for every fifteen words.

Only stretches whose anchor occurs in another document too are verified, in two steps.  The words of a whole stretch
are hashed to 128 bits; a stretch whose words a lesser document has as one of its stretches is a repeat as a whole.
Of what is left, the least document of each stretch, single windows are hashed, where the anchor has several different
stretches.  The least document of each hash comes from partial aggregation, and windows that start in a lesser document
are repeats.  All words that repeats cover are removed.

Nulls and texts shorter than a window lose nothing.  Rows with a null id neither lose nor cause a loss.  Rows that share
an id are one document as far as "lesser" goes and are cut each by itself.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.frames import free_name, offsets_of, staged, text_slices

#: Words of a window, rounds, and the longest symbol in words.
WINDOW, ROUNDS, SYMBOL_WORDS = 50, 6, 8
#: Rounds that name runs before pairs.  Knowing where a run ends costs a symbol of context on either side.
RUN_ROUNDS = (0, 1, 2)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(31))


def _name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mix(_mix(a + np.uint64(salt)) * _A + b)


def recompress(tokens: np.ndarray, walls: np.ndarray, rounds: int = ROUNDS, longest: int = SYMBOL_WORDS,
               run_rounds: tuple[int, ...] = RUN_ROUNDS):
    """``name, start, end, low, high`` of the symbols left after the rounds.

    ``walls`` marks positions that never join a symbol; the first and the last position must be walls.  A symbol spans
    ``[start, end)`` and depended on ``[low, high)``; all four never decrease from symbol to symbol.
    """
    name, wall = tokens, walls
    start = np.arange(len(tokens), dtype=np.int64)
    end, low, high = start + 1, start, start + 1
    for salt in range(rounds):
        if salt in run_rounds:
            # Runs of one symbol become one; both neighbours had to be seen to differ.
            first = np.ones(len(name), bool)
            first[1:] = (name[1:] != name[:-1]) | wall[1:] | wall[:-1]
            at = np.flatnonzero(first)
            last = np.r_[at[1:], len(name)] - 1
            many = last > at
            grown = name[at]
            grown[many] = _name(grown[many], (last - at + 1)[many].astype(np.uint64), 2 * salt + 1)
            low, high = low[np.maximum(at - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]
            name, wall, start, end = grown, wall[at], start[at], end[last]
        # Pairs.
        right = (_mix(name ^ np.uint64((int(_A) * (2 * salt + 3)) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = (~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:] & (end[1:] - start[:-1] <= longest))
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        free = ~joins & ~joined & ~wall
        new_low, new_high = low.copy(), high.copy()
        i = np.flatnonzero(free & right)
        new_low[i] = low[i - 1]
        i = np.flatnonzero(free & ~right)
        new_high[i] = high[i + 1]
        i = np.flatnonzero(joins)
        pair = name.copy()
        pair[i] = _name(name[i], name[i + 1], 2 * salt + 2)
        new_high[i], new_end = high[i + 1], end.copy()
        new_end[i] = end[i + 1]
        keep = ~joined
        name, wall, start, end = pair[keep], wall[keep], start[keep], new_end[keep]
        low, high = new_low[keep], new_high[keep]
    return name, start, end, low, high


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo..hi]`` for each pair of places, by a table of minima over powers of two."""
    out = np.empty(len(lo), values.dtype)
    level, table = 0, values
    size = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    while True:
        now = np.flatnonzero(size == level)
        if len(now):
            out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << level) + 1])
        if not len(size) or level >= size.max():
            return out
        step = 1 << level
        if len(table) <= step:
            return out
        table = np.minimum(table[:-step], table[step:])
        level += 1


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        self._most, self._places, self._hashes = most, {}, np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._places) > self._most:
            self._places, self._hashes = {}, np.zeros(0, np.uint64)
        places, digest = self._places, xxhash.xxh64_digest
        new = list(set(words).difference(places))
        places.update(zip(new, range(len(places), len(places) + len(new))))
        self._hashes = np.concatenate([self._hashes, np.frombuffer(b"".join([digest(w) for w in new]), np.uint64)])
        return self._hashes[np.fromiter(map(places.__getitem__, words), np.int64, len(words))]


def stretches(texts: list[bytes], hash_words: Words, window: int = WINDOW):
    """``text number, name, hash, first window, last window`` for stretches of windows that share an anchor.

    The hash is of all words that the stretch covers, as 16 bytes.
    """
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    starts = offsets_of(counts + 1)[:-1] + 1
    total = int(counts.sum() + len(split) + 1)
    tokens, walls = np.zeros(total, np.uint64), np.ones(total, bool)
    inside = np.repeat(starts - offsets_of(counts)[:-1], counts) + np.arange(counts.sum())
    tokens[inside] = hash_words([w for words in split for w in words])
    walls[inside] = False
    name, _, _, low, high = recompress(tokens, walls)
    name = _mix(name)
    windows = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(split)), windows)
    relative = np.arange(windows.sum()) - np.repeat(offsets_of(windows)[:-1], windows)
    at = starts[text] + relative
    first = np.searchsorted(low, np.arange(total + 1), "left")[at]
    last = np.searchsorted(high, np.arange(total + 1), "right")[at + window] - 1
    covered = last >= first
    chosen = np.empty(len(at), np.uint64)
    chosen[covered] = _least(name, first[covered], last[covered])
    for i in np.flatnonzero(~covered).tolist():
        p = relative[i]
        chosen[i] = xxhash.xxh64_intdigest(b" ".join(split[text[i]][p:p + window]), 1)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    edge = np.flatnonzero(new)
    close = np.r_[edge[1:], len(at)].astype(np.int64)[: len(edge)] - 1
    numbers, firsts, lasts = text[edge], relative[edge], relative[close]
    digest, hashes, current, joined, ends = xxhash.xxh3_128_digest, [], -1, b"", None
    for n, a, b in zip(numbers.tolist(), firsts.tolist(), lasts.tolist()):
        if n != current:
            current, joined, ends = n, b" ".join(split[n]), _ends(split[n])
        hashes.append(digest(joined[ends[a]:ends[b + window] - 1]))
    return numbers, chosen[edge], hashes, firsts, lasts


def _ends(words: list[bytes]) -> list[int]:
    """Where each word starts once all are joined by blanks, and where one more word would."""
    return offsets_of(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()


_STRETCH = "name bigint, hash binary, doc_id bigint, key bigint, first int, last int"
_WINDOW = "hash binary, doc_id bigint, key bigint, at int"


def _stretch_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hash_words = Words()
    for batch in batches:
        for part in text_slices(batch, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            numbers, name, hashes, first, last = stretches(texts, hash_words, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(hashes, pa.binary()), part.column("doc_id").take(pa.array(numbers)),
                 part.column("key").take(pa.array(numbers)), pa.array(first.astype(np.int32)),
                 pa.array(last.astype(np.int32))], ["name", "hash", "doc_id", "key", "first", "last"])


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            hashes, places, numbers = [], [], []
            for n, (text, found) in enumerate(zip(part.column("text").cast(pa.binary()).to_pylist(),
                                                  part.column("found").to_pylist())):
                words = text.split()
                joined, ends = b" ".join(words), _ends(words)
                at = sorted({p for x in found for p in range(x["first"], x["last"] + 1)})
                hashes += [digest(joined[ends[p]:ends[p + window] - 1]) for p in at]
                places += at
                numbers += [n] * len(at)
            rows = pa.array(numbers, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), part.column("doc_id").take(rows), part.column("key").take(rows),
                 pa.array(places, pa.int32())], ["hash", "doc_id", "key", "at"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """The rows with a key that equal rows share and others do not."""
    return docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, key, spans`` of the rows that have repeats: spans of words (start, end) to remove, merged by the reader.

    ``key`` is the hash of id and text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _keyed(rows.where("doc_id is not null and text is not null"), "doc_id", "text", "key")
    found = staged(rows.mapInArrow(lambda b: _stretch_rows(b, window), _STRETCH), "substrings-stretches")
    ends = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    shared = staged(found.groupBy("name").agg(*ends).where("least < most").select("name"), "substrings-shared")
    found = staged(found.join(shared, "name"), "substrings-candidates")

    # Whole stretches.
    content = staged(found.groupBy("name", "hash").agg(F.min("doc_id").alias("least")), "substrings-contents")
    placed = found.join(content, ["name", "hash"])
    whole = placed.where("doc_id > least").select(
        "doc_id", "key", F.struct(F.col("first").alias("start"), (F.col("last") + window).alias("end")).alias("span"))

    # Single windows, where an anchor has more than one stretch.
    several = staged(content.groupBy("name").count().where("count > 1").select("name"), "substrings-several")
    single = (placed.where("doc_id = least").join(several, "name").groupBy("doc_id", "key")
              .agg(F.collect_set(F.struct("first", "last")).alias("found")))
    windows = staged(rows.join(single, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select(
        "doc_id", "key", "text", "found").mapInArrow(lambda b: _window_rows(b, window), _WINDOW), "substrings-windows")
    least = staged(windows.groupBy("hash").agg(*ends).where("least < most").select("hash", "least"), "substrings-least")
    parts = windows.join(least, "hash").where("doc_id > least").select(
        "doc_id", "key", F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end")).alias("span"))
    return whole.unionByName(parts).groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   out: str = "kept", counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """All rows and columns, with the words left joined by blanks, and how many words there were and went."""
    out, counts = free_name(docs, out), tuple(free_name(docs, c) for c in counts)
    key, spans, own = free_name(docs, "_key"), free_name(docs, "_spans"), free_name(docs, "_doc")
    found = staged(repeated_spans(docs, id_col, text_col, window), "substrings-spans").select(
        F.col("doc_id").alias(own), F.col("key").alias(key), F.col("spans").alias(spans))
    keyed = _keyed(docs, id_col, text_col, key)
    joined = keyed.join(found.withColumnRenamed(key, key + "_"), (F.col(key) == F.col(key + "_")) & (
        F.col(id_col).cast("bigint") == F.col(own)), "left").drop(key, key + "_", own)
    fields = [T.StructField(out, T.StringType(), False), *[T.StructField(c, T.LongType(), False) for c in counts]]
    schema, columns = T.StructType([*docs.schema.fields, *fields]), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                kept, n, gone = [], [], []
                for text, cuts in zip(part.column(text_col).cast(pa.binary()).to_pylist(),
                                      part.column(spans).to_pylist()):
                    words = (text or b"").split()
                    stay = np.ones(len(words), bool)
                    for cut in cuts or []:
                        stay[cut["start"]:cut["end"]] = False
                    left = words if stay.all() else [words[i] for i in np.flatnonzero(stay).tolist()]
                    kept.append(b" ".join(left))
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*columns, out, *counts])

    return joined.select(*columns, spans).mapInArrow(run, schema)
