"""Centroids, source divergence and fingerprints against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import struct

import helpers
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonedeck.llm import centroids, divergence, fingerprints, queries


def with_clashing(df):
    """Columns named like those the operators make."""
    return df.withColumns({c: F.lit("own") for c in ("v", "cluster", "distance", "key", "next", "sketch", "range", "guest", "n_chars",
                                                     "term", "g", "rank", "value", "part", "item", "row", "h", "best")})


# Centroids.

def cluster_by_brute_force(rows, clusters, dims, rounds, seed=1):
    kept, most = [], (1 << 63) - 1
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    held = [v for _, v in sorted(kept, key=hashed)[:clusters]]
    best = lambda v: min((min(most, sum((a - b) ** 2 for a, b in zip(v, c))), j) for j, c in enumerate(held))
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for _, v in kept:
            mine[best(v)[1]].append(v)
        held = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if j in mine else c for j, c in enumerate(held)]
    out = [(i, best(v)[1], best(v)[0]) for i, v in kept]
    sums = collections.Counter()
    for _, c, d in out:
        sums[c] += min(d, most)
    return [(i, c, min(d, most), min(sums[c], most), min(sum(sums.values()), most),
             hashlib.sha256(",".join(map(str, held[c])).encode()).hexdigest()) for i, c, d in out]


def test_clusters_by_brute_force(spark):
    random.seed(21)
    rows = [(i, [random.choice([-2.5, -0.01, 0.0, 0.3, 1.0]) + random.random() for _ in range(5)]) for i in range(150)]
    rows += [(1000 + i, [0.25] * 5) for i in range(60)] + [(7, [0.5] * 5), (7, [0.5] * 5), (None, [0.1] * 5), (None, [0.2] * 5)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [1.0] * 6), (304, [1.0, None, 1.0, 1.0, 1.0]),
             (305, [math.nan] * 5), (306, [1.0, math.inf, 0.0, 0.0, 0.0]), (307, [-math.inf] * 5)]
    random.shuffle(rows)
    df = with_clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).repartition(3)
    for clusters, rounds in ((16, 3), (3, 5), (400, 1)):
        got = centroids.cluster_vectors(df, clusters=clusters, dims=5, rounds=rounds)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
            map(repr, cluster_by_brute_force(rows, clusters, 5, rounds)))
    none = centroids.cluster_vectors(df.where("1 = 0"), dims=5)
    assert none.count() == 0 and none.schema.simpleString() == got.schema.simpleString()


def test_clusters_of_large_numbers(spark):
    """Components whose squares or sums do not fit 64 bits any more."""
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(
        [(1 << 40, 5), ((1 << 40) + 3, 5), (-(1 << 55), 0), (-(1 << 55), 64), (0, 0), (1, 1), (1 << 55, 1 << 55)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = centroids.cluster_vectors(df, clusters=3, dims=2, rounds=2).collect()
    assert sorted(map(tuple, got)) == sorted(cluster_by_brute_force(rows, 3, 2, 2))
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id bigint, embedding array<double>")
    assert [r.distance for r in centroids.cluster_vectors(far, dims=2).collect()] == [0, 0]


def test_centroid_ties_take_the_smaller_number(spark):
    point = spark.createDataFrame([([0, 0],)], "v array<bigint>")
    for narrow in (True, False):
        best = centroids.nearest(F.col("v"), [[3, 4], [0, 5], [5, 0], [9, 9]], narrow)
        assert tuple(point.select(best.alias("b")).first().b) == (25, 0)


# Divergence.

def audit_by_brute_force(docs, min_docs, top):
    names = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
                       for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    rows = [(names(t), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        seen = collections.Counter(t for r in own for t in set(r[0]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        count = {s: collections.Counter() for _, _, s in own}
        for words, _, s in own:
            count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), collections.Counter())
        part = lambda c, t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        p = {s: {t: part(c, t) for t in kept} for s, c in count.items()}
        q = {t: part(whole, t) for t in kept}
        for s in count:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])
            for name, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, name, o.decode(), -v, k + 1) for k, (v, o) in enumerate(found)]
    return out


def audited(spark, docs, **options):
    df = with_clashing(spark.createDataFrame(docs, "text string, lang string, source string")).repartition(3)
    return sorted(map(tuple, divergence.audit_sources(df, **options).collect()))


WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "漢字", "😀x", "AbC", "abc", "İi"]


def some_docs(n, sources):
    docs = []
    for i in range(n):
        source = f"s{random.randrange(sources)}"
        words = random.choices(WORDS, [1 / (1 + (k + hash(source)) % 40) for k in range(len(WORDS))], k=random.randint(0, 60))
        docs.append((random.choice([" ", "-", "1\n", "_"]).join(words), random.choice(["en", "en", "fr", None]), source))
    return docs


@pytest.mark.parametrize("sides", [{}, {"side_bits": 3, "leaf_bits": 1}, {"side_bits": 2, "leaf_bits": 2}])
def test_divergence_by_brute_force(spark, sides):
    """With squares of few groups and terms, several squares meet for each pair of groups."""
    random.seed(22)
    docs = some_docs(160, 19) + [(None, "en", "s1"), ("", "en", "empty"), ("rare words only", "zz", "a"), (None, None, None),
                                 ("x", "zz", "b"), ("x x x", "zz", "é"), ("one", "alone", "s"), ("abc " * 20_000, "en", "long")]
    docs += [("hot wa wb", "en", "hot")] * 80
    assert audited(spark, docs, min_docs=4, top=7, **sides) == sorted(audit_by_brute_force(docs, 4, 7))
    assert audited(spark, docs, min_docs=10 ** 6, **sides) == sorted(audit_by_brute_force(docs, 10 ** 6, 50))


def test_divergence_of_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit_sources(df).count() == 0


def test_terms_of_pieces(monkeypatch):
    random.seed(23)
    monkeypatch.setattr(divergence, "PIECE", 7)
    for _ in range(300):
        text = "".join(random.choice("ab C1 é😀_") for _ in range(random.randint(0, 60)))
        whole = re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.encode().lower())
        assert [t for piece in divergence.term_pieces(text.encode()) for t in piece] == whole


# Fingerprints.

def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chained(numbers, seed=42):
    """The hash of several numbers: that of each is the seed of the next one's."""
    for n in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", n), seed & ((1 << 64) - 1))
    return signed(seed)


def shingles_of(text, size=5):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in helpers.WORDS.findall((text or "").lower())]
    if len(words) >= size:
        return {chained(words[i:i + size]) for i in range(len(words) - size + 1)}
    whole = 42
    for w in words:
        whole = chained([whole, w])
    return {whole} if words else set()


def like(a, b, k):
    union = sorted(a | b)[:k]
    low = set(sorted(a)[:k]) & set(sorted(b)[:k])
    return len(low & set(union)) / len(union) if union else 1.0


def fingerprints_by_brute_force(docs, k):
    single = sorted({(i is None, i or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t in docs})
    found = {}
    for at, row in enumerate(single):
        text, after = row[3], single[(at + 1) % len(single)][3]
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + after[:quarter]
        own, other, following = shingles_of(text), shingles_of(changed), shingles_of(after)
        found[row] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), sorted(own)[:k], sorted(other)[:k],
                      like(own, other, k), like(own, following, k))
    return [(i, *found[(i is None, i or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "")]) for i, t in docs]


NASTY = [(1, None), (1, None), (2, ""), (3, " \n\t "), (None, "no id"), (None, None), (4, "twice"), (4, "twice"), (4, "other"),
         (5, "x" * 20_000), (6, "é漢😀 \x1c\x85  end Of It all"), (7, "a\n\n b  c\n"), (8, "word " * 3_000), (-9, "One two")]


@pytest.mark.parametrize("repeats", [False, True])
def test_fingerprints_by_brute_force(spark, repeats):
    random.seed(24)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = docs[:80] + [(i + 1000, t) for i, t in NASTY if i is not None]
    if repeats:
        docs += NASTY + [(55_555, "hot copy of a text")] * 300
    else:
        docs = list({i: (i, t) for i, t in docs}.values())
    random.shuffle(docs)
    df = with_clashing(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(5)
    got = fingerprints.fingerprint_documents(df, k=16)
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, r.sketch, r.edited_sketch, r.near_edited, r.near_next) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, fingerprints_by_brute_force(docs, 16)))


def test_fingerprints_of_few_rows(spark):
    for docs in ([], [(1, "only one document here and no other")], [(2, "b"), (1, None)]):
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = fingerprints.fingerprint_documents(df).collect()
        assert sorted((r.doc_id, r.edited_sha256, r.near_next) for r in got) == sorted(
            (r[0], r[2], r[6]) for r in fingerprints_by_brute_force(docs, 128))


def test_sketch_of_parts(spark):
    """Parts of any length, and merged sketches, give the sketch of the whole."""
    random.seed(25)
    texts = ["".join(random.choice("ab C\n é") for _ in range(random.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = {r.text: r.s for r in df.select("text", fingerprints.sketch(F.col("text"), 9).alias("s")).collect()}
    assert all(whole[t] == sorted(shingles_of(t))[:9] for t in texts)
    for part in (1, 5, 20):
        rows = df.select("text", fingerprints.sketch(F.col("text"), 9, part=part).alias("s")).collect()
        assert all(r.s == whole[r.text] for r in rows)
    tables = df.select(F.length("text").alias("n"), fingerprints.sketch(F.col("text"), 9).alias("sketch"))
    merged = {r.n: r.sketch for r in fingerprints.merge_parts(tables, "n", k=9).collect()}
    for n in {len(t) for t in texts}:
        assert merged[n] == sorted(set().union(*[shingles_of(t) for t in texts if len(t) == n]))[:9]


def test_estimates(spark):
    """Estimates of 3,000 shingles, of which the texts share given numbers, lie within four standard errors."""
    rows = [(shared, " ".join(f"s{i}" for i in range(shared)) + " ".join(f" a{i}" for i in range(3004 - shared)),
             " ".join(f"s{i}" for i in range(shared)) + " ".join(f" b{i}" for i in range(3004 - shared)))
            for shared in (0, 600, 1500, 2700, 3004)]
    df = spark.createDataFrame(rows, "shared int, a string, b string").select(
        "shared", "a", "b", *[fingerprints.sketch(F.col(c)).alias(f"s{c}") for c in "ab"])
    a, b = F.col("sa"), F.col("sb")
    for r in df.select("shared", "a", "b", fingerprints.resemblance(a, b).alias("alike"),
                       fingerprints.containment(a, b).alias("inside"), fingerprints.distinct_shingles(a).alias("n")).collect():
        own, other = shingles_of(r.a), shingles_of(r.b)
        alike = len(own & other) / len(own | other)
        assert abs(r.alike - alike) <= 4 * math.sqrt(alike * (1 - alike) / 128) + 1e-9
        assert abs(r.inside - len(own & other) / len(own)) <= 0.25
        assert abs(r.n / len(own) - 1) <= 4 / math.sqrt(126)


def test_native_plan(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_fingerprints(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Window ") == 1
    rows = found.collect()
    assert len(rows) == 9 and np.isclose(sum(r.near_edited == 1.0 for r in rows), 0, atol=9)
