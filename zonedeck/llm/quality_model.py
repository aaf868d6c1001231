"""A quality score from a byte-level convolutional network written in numpy.

Bytes are embedded, and learned filters slide over the whole text.  Responses are pooled by their maximum within chunks
of two hops, each chunk overlapping the next by one hop; mean and maximum over all chunks of a text give one
probability by a logistic layer.  The network is trained on the driver from a bounded sample of labelled rows,
``SAMPLE_ROWS`` texts of at most 64 KiB, and scores whole texts of any length in the tasks.

Filters start at every byte, so the whole text is seen.  Null and empty texts have no responses and get the score that the bias alone gives.  Without labels of both kinds all
scores are the share of label 1.  Rows are independent: repeated rows, null ids and other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.frames import free_name, id_text, with_python
from zonedeck.llm.samples import fold, labelled_sample, share_of

#: Most labelled rows that the driver trains on.
SAMPLE_ROWS = 3000
#: Bytes seen by a filter, numbers for a byte, filters, bytes from one place of a filter to the next, and bytes of a hop.
WIDTH, DIMS, FILTERS, STRIDE, HOP = 6, 6, 24, 1, 128
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Places whose responses are computed together.
BLOCK_HOPS = 512
HELD_OUT = (4, 2)
PREDICT_FROM = 0.7


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(*[x.astype(np.float32) for x in (
            rng.normal(0, 1, (256, DIMS)), rng.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)),
            np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1))])

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each filled up with zeros to whole hops; valid places; hops of each text (at least one)."""
    hops = np.array([max(1, -(-(len(t) + WIDTH - 1) // HOP)) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(h * HOP, b"\0") for t, h in zip(texts, hops.tolist())) + bytes(WIDTH), np.uint8)
    starts = (np.cumsum(hops) - hops) * HOP
    # A filter starts at every byte of its text; at the end it sees zeros.
    last = starts + np.array([len(t) for t in texts]) - 1
    place = np.arange(0, int(hops.sum()) * HOP, STRIDE)
    return flat, place <= np.repeat(last, hops * (HOP // STRIDE)), hops


def _responses(net: Network, flat: np.ndarray, valid: np.ndarray, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and rectified responses of ``count`` hops from hop ``first`` on."""
    piece = flat[first * HOP:(first + count) * HOP + WIDTH]
    seen = np.lib.stride_tricks.sliding_window_view(net.embedding[piece].ravel(), WIDTH * DIMS)[
        : count * HOP * DIMS: STRIDE * DIMS]
    out = np.maximum(seen @ net.filters + net.bias, 0)
    out *= valid[first * HOP // STRIDE:(first + count) * HOP // STRIDE, None]
    return seen, out


def _pooled(tops: np.ndarray, hops: np.ndarray):
    """Chunk maxima from hop maxima, and where each text's chunks start."""
    ends = np.cumsum(hops)
    following = np.arange(len(tops)) + 1
    following[ends - 1] = ends - 1  # the last hop has no next one
    lone = hops == 1
    keep = np.ones(len(tops), bool)
    keep[(ends - 1)[~lone]] = False
    own = np.flatnonzero(keep)
    chunks = np.maximum(tops[own], tops[following[own]])
    counts = np.where(lone, 1, hops - 1)
    return chunks, own, following[own], counts, np.cumsum(counts) - counts


def features(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean and maximum of the chunks of each text."""
    flat, valid, hops = _laid_out(texts)
    total = int(hops.sum())
    tops = np.concatenate([_responses(net, flat, valid, i, min(BLOCK_HOPS, total - i))[1]
                           .reshape(-1, HOP // STRIDE, FILTERS).max(1) for i in range(0, total, BLOCK_HOPS)])
    chunks, _, _, counts, starts = _pooled(tops, hops)
    return np.hstack([np.add.reduceat(chunks, starts) / counts[:, None], np.maximum.reduceat(chunks, starts)])


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    z = features(net, texts).astype(np.float64) @ net.weights.astype(np.float64) + float(net.offset[0])
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _gradients(net: Network, texts: list[bytes], wanted: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    flat, valid, hops = _laid_out(texts)
    total, per_hop = int(hops.sum()), HOP // STRIDE
    tops, places = [], []
    for i in range(0, total, BLOCK_HOPS):
        n = min(BLOCK_HOPS, total - i)
        out = _responses(net, flat, valid, i, n)[1].reshape(n, per_hop, FILTERS)
        places.append(out.argmax(1) * STRIDE + (np.arange(i, i + n) * HOP)[:, None])
        tops.append(out.max(1))
    tops, places = np.concatenate(tops), np.concatenate(places)
    chunks, own, following, counts, starts = _pooled(tops, hops)
    mean, peak = np.add.reduceat(chunks, starts) / counts[:, None], np.maximum.reduceat(chunks, starts)
    pooled = np.hstack([mean, peak])
    z = pooled @ net.weights + net.offset[0]
    slope = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - wanted) * weight / len(texts)).astype(np.float32)
    text = np.repeat(np.arange(len(texts)), counts)
    to_chunk = (slope[:, None] * net.weights[:FILTERS] / counts[:, None])[text]
    top = chunks == peak[text]
    top &= np.cumsum(top, 0) - np.repeat(np.cumsum(top, 0)[starts] - top[starts], counts, axis=0) == 1
    to_chunk += top * (slope[:, None] * net.weights[FILTERS:])[text]
    to_hop = np.zeros_like(tops)
    second = tops[following] > tops[own]
    np.add.at(to_hop, own, to_chunk * ~second)
    np.add.at(to_hop, following, to_chunk * second)
    to_hop *= tops > 0
    codes = flat[places[:, :, None] + np.arange(WIDTH)]
    seen = net.embedding[codes].reshape(total, FILTERS, WIDTH * DIMS)
    d_filters = np.einsum("hf,hfx->xf", to_hop, seen, optimize=True)
    back = (to_hop[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
    d_embedding = np.stack([np.bincount(codes.ravel(), back[:, k], 256) for k in range(DIMS)], 1)
    return [d_embedding, d_filters, to_hop.sum(0), pooled.T @ slope, slope.sum(keepdims=True)]


def train(sample: list[tuple[bytes, int]], share: float = 0.5, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam; rows are weighted so that the scores suit a share of label 1 of ``share``."""
    net = Network.fresh(seed)
    ones = sum(y for _, y in sample)
    if not 0 < ones < len(sample):
        net.offset[0] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return net
    by_label = {1: share * len(sample) / ones, 0: (1 - share) * len(sample) / (len(sample) - ones)}
    rng, step = np.random.default_rng(seed), 0
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    rounds = epochs * -(-len(sample) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), BATCH):
            rows = [sample[j] for j in order[i:i + BATCH]]
            wanted = np.array([y for _, y in rows], np.float32)
            slopes = _gradients(net, [t for t, _ in rows], wanted, np.where(wanted > 0, by_label[1], by_label[0]))
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            for a, d, (m, v) in zip(net.arrays(), slopes, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                a -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def with_scores(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the probability of good quality appended."""
    def make():
        return lambda texts: [score(net, texts)]

    return with_python(docs, text_col, [T.StructField(free_name(docs, out), T.DoubleType(), False)], make)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE_ROWS) -> Network:
    """Train on a sample of the labelled rows outside the held-out fold."""
    allowed = fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]
    return train(labelled_sample(docs, labels, label_col, allowed, most), share_of(labels, label_col, allowed))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    scored = with_scores(id_text(docs), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
