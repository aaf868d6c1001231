"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.  Every window of
``NGRAM`` consecutive words of a benchmark item, or a shorter item as a whole, goes into the set.  Tasks look each of
their words up in the benchmark's vocabulary, hash only stretches of known words, and compare the words of a hash hit.

A benchmark is cut into blocks of bounded text size.  Each block is a broadcast and a pass of its own over the same rows,
all in one stage and without a shuffle; a benchmark of many blocks takes as many Python workers in a task.

A text that is null or has no words has no hits, as has an item.  Rows are independent: repeated rows and ids, null ids
and other columns, whatever their names, pass through; a very long text is a slice of its own.  Items that share an id
count once; the windows of an item without an id hit words and are in no list of items.  Empty tables work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.frames import free_name, offsets_of, text_slices

NGRAM = 10
#: Text bytes of the benchmark items broadcast together.  A single longer item is a block of its own.
BLOCK_BYTES = 8 << 20

#: Bytes outside words become blanks, A-Z becomes a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a decoded text, for their places.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MIX = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Grams:
    """The windows of a block of items: vocabulary, hashes by window length, and the words behind each hash."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = NGRAM):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(len(ids) - n, 0) + 1 if ids else 0):
                window = tuple(ids[i:i + n])
                known = self.windows.setdefault(len(window), {}).setdefault(window, set())
                if item is not None:
                    known.add(item)

    def prepare(self) -> None:
        """Sorted hashes for the lookup; done once in each task."""
        self.powers = np.array([pow(_MIX, k, 1 << 64) for k in range(max(self.windows, default=0))], np.uint64)
        self.hashes = {n: np.unique(self._hash(np.array(list(w), np.uint64).T)) for n, w in self.windows.items()}

    def _hash(self, columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for k, column in enumerate(columns):
            total += (column + np.uint64(k + 1)) * self.powers[k]
        return total

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Word count, hit windows (start, end) and items of each text."""
        split = [words_of(t) for t in texts]
        out = [(len(w), [], set()) for w in split]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.vocabulary.get
        ids = np.zeros(int((counts + 1).sum()), np.uint64)
        starts = offsets_of(counts + 1)
        for words, start in zip(split, starts.tolist()):
            ids[start:start + len(words)] = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        unknown = offsets_of((ids == 0).astype(np.int64))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:len(unknown) - n])
            if not len(at):
                continue
            values = self._hash([ids[at + k] for k in range(n)])
            place = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            for p in at[hashes[place] == values].tolist():
                items = self.windows[n].get(tuple(ids[p:p + n].tolist()))
                if items is not None:
                    row = int(np.searchsorted(starts, p, "right")) - 1
                    begin = p - int(starts[row])
                    out[row][1].append((begin, begin + n))
                    out[row][2].update(items)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    held, size = [], 0
    for row in rows.where("text is not null").toLocalIterator():
        raw = row.text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((row.item, raw))
        size += len(raw)
    if held:
        yield held


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False)])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", n: int = NGRAM, out: str = "found",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns plus ``found``: n_words, hit spans of words (start, end), and the sorted ids of hit items."""
    out = free_name(docs, out)
    kind = pa.struct([("n_words", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                      ("items", pa.list_(pa.string()))])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _FOUND, False)])
    result, first = docs, True
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, item_col, item_text, block_bytes) if benchmark.take(1) else []:
        result, first = result.mapInArrow(_scan(context.broadcast(Grams(block, n)), text_col, out, kind, first), schema), False
    if first:
        result = result.mapInArrow(_scan(context.broadcast(Grams([], n)), text_col, out, kind, True), schema)
    return result


def _scan(shared, text_col: str, out: str, kind: pa.DataType, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        grams.prepare()
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                earlier = [None] * len(texts) if first else part.column(out).to_pylist()
                rows = []
                for (count, spans, items), old in zip(grams.find(texts), earlier):
                    if old:
                        spans = spans + [(x["start"], x["end"]) for x in old["spans"]]
                        items = items | set(old["items"])
                    rows.append({"n_words": count, "spans": [{"start": a, "end": b} for a, b in merge(spans)],
                                 "items": sorted(items)})
                names = [c for c in part.schema.names if c != out or first]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(rows, kind)], [*names, out])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", action: str = "drop",
                  **options) -> DataFrame:
    """The documents without contamination: ``drop`` leaves out documents with hits, ``cut`` their hit words.

    Cutting takes the text from the first to the last hit word of a span; columns stay as they are.
    """
    if action not in ("drop", "cut"):
        raise ValueError("action must be drop or cut")
    found = free_name(docs, "found")
    scanned = find_contamination(docs, benchmark, text_col, out=found, **options)
    if action == "drop":
        return scanned.where(F.size(f"{found}.spans") == 0).select(*docs.columns)
    schema, columns = docs.schema, docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, x in enumerate(batch.column(found).to_pylist()):
                if x["spans"]:
                    places = [m.span() for m in _WORD.finditer(texts[i])]
                    kept, end = [], 0
                    for s in x["spans"]:
                        kept.append(texts[i][end:places[s["start"]][0]])
                        end = places[s["end"] - 1][1]
                    texts[i] = "".join([*kept, texts[i][end:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns], columns)

    return scanned.mapInArrow(cut, schema)
