"""Byte-level BPE encoding and decoding with padded matrices.

Pieces of a text (the matches of the tokenizer's pattern) are laid into matrices, one for each length class, one byte
token in each cell.  In every round every row merges its leftmost pair of least rank: ranks come from a hash table of
token pairs, the row's cells behind the merge move up by one, and rows without a pair left leave the matrix.  Texts are
first cut into words at single blanks, where the pattern always starts a new piece.  A word is cut into pieces and
encoded once per slice of texts, however often it occurs; a bounded memo carries words over to later slices.
Pieces of over ``LONG_PIECE`` bytes take the same merges in the same order from a heap, because rounds over such a row
would cost the square of its length.

Null and empty texts give no tokens.  Rows are independent: repeated rows and ids, null ids and further columns pass
through, in the same order; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from zonedeck.llm.frames import free_name, with_python

#: Beyond this many bytes a piece is merged by a heap.
LONG_PIECE = 1024
#: Cells of one matrix.
CELLS = 1 << 17
#: Text bytes that are cut into words together.
SLICE_BYTES = 1 << 20
#: Words remembered from slice to slice, at most twice as many and those of a slice.
MEMO = 50_000
#: A rank file beyond this size is refused: every task gets the whole of it.
MAX_RANK_BYTES = 64 << 20

_NONE = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Vocabulary:
    """A rank file and the pattern that cuts text into pieces, as plain values that travel to tasks."""

    lines: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            lines = f.read(MAX_RANK_BYTES + 1)
        if len(lines) > MAX_RANK_BYTES:
            raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
        return cls(lines, pattern)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


class Codec:
    """Merges and token bytes of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.lines.splitlines() if x)}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file has no token for bytes {missing[:5]}")
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # \s as in the tokenizer's own engine: Unicode white space, without the separators \x1c to \x1f.
        self.pieces = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(
            r"\S", r"\P{White_Space}")).findall
        self._table(ranks)
        self._young: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}

    def _table(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, _EMPTY, np.uint64)
        self._values = np.full(1 << bits, _NONE, np.int32)
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = ((keys * _MIX) >> self._shift).astype(np.int64)
        while len(keys):
            free = self._keys[slots] == _EMPTY
            self._keys[slots[free]] = keys[free]
            placed = self._keys[slots] == keys
            self._values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self._mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or the largest integer where there is none; padding is negative."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = ((keys * _MIX) >> self._shift).astype(np.int64)
        there = self._keys[slots]
        out = np.where(there == keys, self._values[slots], _NONE)
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY) & (left >= 0) & (right >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self._mask
            there = self._keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self._values[slots[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Token ids, packed, of pieces of at most ``width`` bytes."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        cells = np.arange(width)[None, :] < lengths[:, None]
        grid = np.full((len(pieces), width), -1, np.int32)
        grid[cells] = self.of_byte[flat]
        ranks = self.pair_ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows = np.arange(len(pieces))
        counts = lengths.copy()
        out: list[bytes] = [b""] * len(pieces)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                live = best != _NONE
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                done = ~live
                kept = counts[done]
                packed = grid[done][np.arange(grid.shape[1])[None, :] < kept[:, None]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(kept)).tolist()
                for row, start, end in zip(rows[done].tolist(), [0, *ends], ends):
                    out[row] = packed[start:end]
                if not live.any():
                    break
                rows, grid, ranks, counts, at, best = (x[live] for x in (rows, grid, ranks, counts, at, best))
            n = np.arange(len(rows))
            grid[n, at] = best
            keep = np.arange(grid.shape[1] - 1)[None, :] <= at[:, None]
            grid = np.where(keep, grid[:, :-1], grid[:, 1:])
            ranks = np.where(keep[:, :-1], ranks[:, :-1], ranks[:, 1:])
            counts = counts - 1
            if ranks.shape[1]:
                inner = at < ranks.shape[1]
                r, c = n[inner], at[inner]
                ranks[r, c] = self.pair_ranks(grid[r, c], grid[r, c + 1])
                before = at > 0
                r, c = n[before], at[before] - 1
                ranks[r, c] = self.pair_ranks(grid[r, c], grid[r, c + 1])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            token = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])
            if token is not None:
                heapq.heappush(heap, (token, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces."""
        found: dict[str, bytes] = {}
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                found[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                found[piece] = self._merge_long(raw)
            else:
                held = classes.setdefault(1 << (len(raw) - 1).bit_length(), ([], []))
                held[0].append(piece)
                held[1].append(raw)
        for width, (names, raws) in classes.items():
            step = max(1, CELLS // width)
            for i in range(0, len(names), step):
                found.update(zip(names[i:i + step], self._merge_rows(raws[i:i + step], width)))
        return found

    def _words(self, words: set[str]) -> None:
        """Put the ids of words, each with the blank before it, into the young memo.

        A blank before a non-blank starts a piece: " ?" takes it and nothing before it can.  Words that are empty or
        start with white space belong to longer runs of it and get None.
        """
        if len(self._young) > MEMO:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        plain, cut = [], []
        for word in words.difference(young):
            if word in old:
                young[word] = old[word]
            elif not word or word[0].isspace():
                young[word] = None
            elif len(word.split()) == 1 and not word[-1].isspace():
                plain.append(word)
            else:
                cut.append((word, self.pieces(" " + word)))
        # All words at once: each starts with the only piece that has its blank.
        pieces = self.pieces(" " + " ".join(plain)) if plain else []
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        cut += [(w, pieces[i:j]) for w, i, j in zip(plain, starts, [*starts[1:], len(pieces)])]
        ids = self.encode_pieces(list(set(pieces).union(*[p for _, p in cut])))
        for word, own in cut:
            young[word] = ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts as packed little-endian unsigned 32-bit integers."""
        cut = [t.decode("utf-8", "replace").split(" ") for t in texts]
        self._words(set().union(*[words[1:] for words in cut]))
        young, out = self._young, []
        heads = [self.pieces(words[0]) for words in cut]
        ids = self.encode_pieces(list(set().union(*heads)))
        for words, head in zip(cut, heads):
            try:
                tail = b"".join([young[w] for w in islice(words, 1, None)])
            except TypeError:  # a longer run of white space: the pattern sees the text as a whole
                head, tail = self.pieces(" ".join(words)), b""
                ids.update(self.encode_pieces(list(set(head).difference(ids))))
            out.append(b"".join([ids[p] for p in head]) + tail)
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join([self.tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def _shared(spark: SparkSession, vocabulary: Vocabulary):
    return spark.sparkContext.broadcast(vocabulary)


def encode_documents(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "token_ids",
                     decoded_col: str | None = None) -> DataFrame:
    """Append the token ids of a text column, packed as little-endian unsigned 32-bit integers in a binary column,
    and on request the bytes that the ids decode to."""
    shared = _shared(df.sparkSession, vocabulary)
    fields = [T.StructField(free_name(df, ids_col), T.BinaryType(), False)]
    if decoded_col:
        fields.append(T.StructField(free_name(df, decoded_col), T.BinaryType(), False))

    def make():
        codec = Codec(shared.value)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            ids = codec.encode(texts)
            return [ids, [codec.decode(x) for x in ids]] if decoded_col else [ids]

        return compute

    return with_python(df, text_col, fields, make, SLICE_BYTES)


def decode_documents(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids",
                     decoded_col: str = "decoded") -> DataFrame:
    """Append the bytes that packed ids decode to; null ids decode to nothing."""
    shared = _shared(df.sparkSession, vocabulary)
    field = T.StructField(free_name(df, decoded_col), T.BinaryType(), False)

    def make():
        codec = Codec(shared.value)
        return lambda packed: [[codec.decode(x) for x in packed]]

    return with_python(df, ids_col, [field], make, SLICE_BYTES)
