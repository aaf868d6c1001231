"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 h`` bits have a fingerprint between them that differs from either in at most
``h`` bits.  So every distinct fingerprint emits all variants within half the radius, the variants are shuffled, and
fingerprints that meet at a variant are linked.  A shared variant also proves the link, as each side is within ``h``
bits of it; the differing bits of colliding pairs are counted all the same before they are emitted.

A variant travels as one 64-bit number: an odd multiplier spreads it over buckets, the bucket stands for its high bits
and the place of those high bits holds the number of the flipped mask, from which the fingerprint follows.  Variants
of a block of fingerprints that fall into the same bucket form one row.  Buckets are worked off in rounds, so that only
a share of all variants is on disk at a time.  Within a bucket neighbours in sorted order are linked, never all pairs.

Nulls and texts without words have fingerprint zero and are linked like others; null ids are kept, and a group's id is
its least id that is not null.  Repeated rows and ids are rows of their own.  An empty table gives an empty table.  A very
long text is hashed piece by piece; further columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.components import connected_components
from zonedeck.llm.frames import free_name, shuffle_width, staged, with_python

#: Words of a shingle, seed of its hash, differing bits that still link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Rounds over the variants; each shuffles this share of them.
ROUNDS = 4
#: Fingerprints whose variants are made together.
BLOCK = 2048
#: Variants a bucket should hold; there are at least 2**12 buckets.
BUCKET_VARIANTS = 1 << 20

_SPREAD = 0x9E3779B97F4A7C15
_BACK = pow(_SPREAD, -1, 1 << 64)
_LOW = 12


def shingle_digests(text: bytes, shingle: int, seed: int = SEED) -> bytes:
    """Hashes, 8 bytes each, of all runs of ``shingle`` lower-cased words (A-Z only); fewer words are one run."""
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends + 1 - lengths)[: len(words) - shingle + 1]
        spans = zip(starts.tolist(), ends[shingle - 1:].tolist())
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in spans])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words (A-Z only), as an unsigned integer."""
    digests = shingle_digests(text, shingle, SEED)
    if not digests:
        return 0
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Append the fingerprint of a text column, as the signed integer of the same bits."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return with_python(df, text_col, [T.StructField(free_name(df, out), T.LongType(), False)], make)


def ball_masks(radius: int) -> np.ndarray:
    """All 64-bit masks of at most ``radius`` set bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)],
                    np.uint64)


def _emit(batches: Iterator[pa.RecordBatch], masks: np.ndarray, bits: int, first: int, count: int):
    shift = np.uint64(64 - bits)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fps), BLOCK):
            spread = ((fps[i:i + BLOCK, None] ^ masks[None, :]) * np.uint64(_SPREAD))
            bucket = spread >> shift
            chosen = (bucket >= first) & (bucket < first + count)
            number = np.broadcast_to(np.arange(len(masks), dtype=np.uint64), spread.shape)[chosen]
            bucket = (bucket[chosen] - np.uint64(first)).astype(np.uint16 if count <= 1 << 16 else np.uint32)
            packed = spread[chosen] << np.uint64(_LOW) | number
            order = np.argsort(bucket, kind="stable")
            bucket, packed = bucket[order], packed[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts].astype(np.int64) + first),
                 pa.array([packed[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                ["bucket", "packed"])


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and, for each, the least node it reaches within them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _meet(batches: Iterator[pa.RecordBatch], masks: np.ndarray, bits: int, radius: int):
    """Link the fingerprints that meet at a variant; a task emits a forest over them, not every meeting."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(bucket, []).append(packed)
    lefts, rights = [], []
    for bucket in sorted(held):
        entries = np.frombuffer(b"".join(held.pop(bucket)), np.uint64).copy()
        entries.sort()
        low = entries >> np.uint64(_LOW)
        same = np.flatnonzero(low[1:] == low[:-1])
        if not len(same):
            continue
        variant = (np.uint64(bucket >> (bits - _LOW) << (64 - _LOW)) | low[same]) * np.uint64(_BACK)
        lefts.append(variant ^ masks[entries[same] & np.uint64((1 << _LOW) - 1)])
        rights.append(variant ^ masks[entries[same + 1] & np.uint64((1 << _LOW) - 1)])
    if not lefts:
        return
    a, b = np.concatenate(lefts), np.concatenate(rights)
    near = np.bitwise_count(a ^ b) <= radius
    nodes, roots = _roots(a[near].view(np.int64), b[near].view(np.int64))
    other = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], ["u", "v"])


def near_links(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints (one bigint column) of at most ``radius`` differing bits.

    Not every such pair is listed, but every one is connected through listed pairs.
    """
    if radius % 2 or radius // 2 > 2:
        raise ValueError("the radius must be 0, 2 or 4")
    masks = ball_masks(radius // 2)
    spark = fps.sparkSession
    count = fps.count()
    bits = max(_LOW, (count * len(masks) // BUCKET_VARIANTS).bit_length())
    share = -(-(1 << bits) // rounds)
    spread = fps.repartition(max(shuffle_width(spark), -(-count // (8 * BLOCK))), fps.columns[0])
    parts = []
    for first in range(0, 1 << bits, share):
        emitted = spread.mapInArrow(lambda b, f=first: _emit(b, masks, bits, f, share), "bucket bigint, packed binary")
        met = (emitted.repartition(max(shuffle_width(spark), -(-count * len(masks) // (rounds << 22))), "bucket")
               .mapInArrow(lambda b: _meet(b, masks, bits, radius), "u bigint, v bigint"))
        parts.append(staged(met.distinct(), "simhash-links"))
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    return links


def near_groups(rows: DataFrame, fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """``fp, root`` for every distinct fingerprint: the group it belongs to, named by one fingerprint."""
    fps = staged(rows.select(F.col(fp_col).alias("fp")).distinct(), "simhash-fps")
    roots = connected_components(near_links(fps, radius), "simhash-components")
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: its fingerprint and the least id of its group."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(with_fingerprints(rows, shingle=shingle).select("doc_id", "fp"), "simhash-rows")
    groups = staged(near_groups(rows, radius=radius), "simhash-groups")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(groups.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, with one row of each group of near copies: the one of least id.

    Among rows of the same id the first read stays; rows without an id stay only where the group has no other.
    """
    key, fp = free_name(docs, "_row"), free_name(docs, "_fp")
    rows = with_fingerprints(docs, text_col, fp, shingle).withColumn(key, F.monotonically_increasing_id())
    rows = staged(rows, "simhash-docs")
    thin = rows.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                                                       F.col(key).alias("row")).alias("first"))
    groups = near_groups(thin, radius=radius)
    first = thin.groupBy("fp").agg(F.min("first").alias("first")).join(groups, "fp").groupBy("root").agg(
        F.min("first").alias("first"))
    return rows.join(first.select(F.col("first.row").alias(key)), key, "left_semi").select(*docs.columns)
