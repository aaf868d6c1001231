"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A word's logit adds up its hashed byte n-grams, a sentence's odds add up its words', so that a long sentence does not
drown one bad word; a document is toxic if any of its sentences is (noisy-or).  Only document labels train the
weights, on the driver, from a bounded sample of ``SAMPLE_ROWS`` texts of at most 64 KiB.  Tasks score every sentence of
whole texts and report the sentences that offend.

Null and empty texts have no sentences and score 0.  Without labels of both kinds all sentences score the share of
label 1.  Rows are independent: repeated rows, null ids and other columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.frames import free_name, id_text, offsets_of, with_python
from zonedeck.llm.samples import fold, labelled_sample, share_of

#: Most labelled rows that the driver trains on.
SAMPLE_ROWS = 4000
#: Weights, lengths of n-grams in bytes, steps, step size, and the pull of weights towards zero.
WEIGHTS, GRAMS, STEPS, RATE, DECAY = 1 << 16, (4, 5), 120, 0.05, 1e-5
#: Words whose scores a task remembers.
MEMO = 500_000
HELD_OUT = (5, 0)
PREDICT_FROM = OFFENDS_FROM = 0.5

#: Bytes that end a sentence become line ends, other ASCII punctuation blanks, A-Z becomes a-z.
_FOLD = bytes(10 if b in b".!?\n\r" else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
              else 32 for b in range(256))


def sentences(text: bytes) -> list[bytes]:
    """The folded sentences; with one byte between them they add up to the text's length."""
    return text.translate(_FOLD).split(b"\n")


def grams(word: bytes) -> list[int]:
    """Places of a word's weights: the word itself and its n-grams, ends marked."""
    marked = b"^" + word + b"$"
    found = {zlib.crc32(marked) % WEIGHTS}
    for n in GRAMS:
        found.update(zlib.crc32(marked[i:i + n], n) % WEIGHTS for i in range(len(marked) - n + 1))
    return sorted(found)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._memo: dict[bytes, float] = {}

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all sentences that have words, and the number of such sentences of each text."""
        split = [[w for s in sentences(t) if (w := s.split())] for t in texts]
        flat = [w for text in split for s in text for w in s]
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        for word in set(flat).difference(memo):
            memo[word] = float(np.exp(min(50.0, self.weights[grams(word)].sum())))
        values = np.fromiter(map(memo.__getitem__, flat), np.float64, len(flat))
        lengths = np.array([len(s) for text in split for s in text], np.int64)
        starts = offsets_of(lengths)[:-1]
        odds = np.add.reduceat(values, starts) if len(starts) else np.zeros(0)
        return self.bias + np.log(odds), np.array([len(text) for text in split], np.int64)


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z)) without overflow."""
    return -np.logaddexp(0, z)


def noisy_or(z: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that some sentence of a text is toxic; 0 for a text without sentences."""
    total = np.concatenate([[0.0], np.cumsum(_log_clean(z))])
    ends = np.cumsum(counts)
    return -np.expm1(np.minimum(0, total[ends] - total[ends - counts]))


def train(sample: list[tuple[bytes, int]], share: float = 0.5, steps: int = STEPS) -> Model:
    """Fit by Adam on the likelihood of the document labels; rows are weighted to a share of label 1 of ``share``."""
    ones = sum(y for _, y in sample)
    model = Model(np.zeros(WEIGHTS), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    if not 0 < ones < len(sample):
        return model
    split = [[w for s in sentences(t) if (w := s.split())] for t, _ in sample]
    kept = [i for i, text in enumerate(split) if text]
    split, labels = [split[i] for i in kept], np.array([sample[i][1] for i in kept], np.float64)
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for text in split for s in text for w in s], np.int64)
    lengths = np.array([len(s) for text in split for s in text], np.int64)
    counts = np.array([len(text) for text in split], np.int64)
    of_sentence, of_text = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(counts)), counts)
    places = [grams(w) for w in number]
    sizes = np.array([len(p) for p in places], np.int64)
    flat = np.array([x for p in places for x in p], np.int64)
    of_word = np.repeat(np.arange(len(places)), sizes)
    weight = np.where(labels > 0, share / max(1, ones), (1 - share) / max(1, len(sample) - ones))
    theta, bias = model.weights, -6.0
    m, v, mb, vb = np.zeros(WEIGHTS), np.zeros(WEIGHTS), 0.0, 0.0
    for step in range(1, steps + 1):
        odds = np.exp(np.minimum(50, np.bincount(of_word, theta[flat], len(places))))[words]
        total = np.bincount(of_sentence, odds, len(lengths))
        z = bias + np.log(total)
        clean = np.bincount(of_text, _log_clean(z), len(counts))
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        # d/dz of -log(1 - prod(1 - p)) for label 1 and of -log prod(1 - p) for label 0.
        pull = np.where(labels > 0, -1 / np.maximum(np.expm1(np.clip(-clean, 1e-12, 700)), 1e-12), 1.0) * weight
        dz = p * pull[of_text]
        d_word = np.bincount(words, (dz / total)[of_sentence] * odds, len(places))
        d = np.bincount(flat, d_word[of_word], WEIGHTS) + DECAY * theta
        m += 0.1 * (d - m)
        v += 0.001 * (d * d - v)
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
        mb += 0.1 * (dz.sum() - mb)
        vb += 0.001 * (dz.sum() ** 2 - vb)
        bias -= RATE * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.999 ** step)) + 1e-7)
    return Model(theta, bias)


def _offending(text: bytes, z: np.ndarray) -> list[dict]:
    """Sentences from ``OFFENDS_FROM`` on: start and end in code points, and probability."""
    out, at, k = [], 0, 0
    for s in sentences(text):
        if s.split():
            p = 1 / (1 + np.exp(-z[k]))
            if p >= OFFENDS_FROM:
                start = len(text[:at].decode("utf-8", "replace"))
                out.append({"start": start, "end": start + len(text[at:at + len(s)].decode("utf-8", "replace")),
                            "score": float(p)})
            k += 1
        at += len(s) + 1
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField(
    "end", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False)]), False)


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score",
                  spans: str = "offending") -> DataFrame:
    """All rows and columns with the document's probability and its offending sentences appended."""
    def make():
        def compute(texts: list[bytes]) -> list:
            z, counts = model.logits(texts)
            starts, low = offsets_of(counts), np.log(OFFENDS_FROM / (1 - OFFENDS_FROM))
            found = []
            for text, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
                found.append(_offending(text, z[a:b]) if a < b and z[a:b].max() >= low else [])
            return [noisy_or(z, counts), found]

        return compute

    return with_python(docs, text_col, [T.StructField(free_name(docs, out), T.DoubleType(), False),
                                        T.StructField(free_name(docs, spans), _SPANS, False)], make)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Train on a sample of the labelled rows outside the held-out fold."""
    allowed = fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]
    return train(labelled_sample(docs, labels, label_col, allowed, most), share_of(labels, label_col, allowed))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for every row."""
    scored = with_toxicity(id_text(docs), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), "offending")
