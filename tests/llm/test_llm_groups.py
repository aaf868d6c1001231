"""Operators that compare documents: near copies, repeats, lines, shards, and the pipeline."""

import collections
import hashlib
import random

import helpers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from zonedeck.llm import components, lines, queries, sharding, simhash, substrings

NASTY = [(1, None), (1, None), (2, ""), (3, " \n\t "), (None, "no id"), (None, None), (4, "twice"), (4, "twice"),
         (5, "x" * 20_000), (6, "é漢😀 \x1c\x85  end"), (7, "a\n\n b  c\n"), (8, "word " * 3_000)]


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("own") for c in ("fp", "_fp", "_row", "kept", "key", "_key", "shard", "hash", "found")})


def roots_of(n, linked):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_by_brute_force(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)]
    edges += [(500, 500 + i) for i in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(df, "test").collect()}
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    place, pairs = {n: i for i, n in enumerate(names)}, {tuple(sorted(e)) for e in edges}
    roots = roots_of(len(names), lambda i, j: (names[j], names[i]) in pairs)
    assert got == {n: names[roots[place[n]]] for n in names}


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = helpers.WORDS.findall(lowered)
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i:i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_by_brute_force(spark, tmp_path):
    random.seed(3)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text").collect()][:120]
    for i in range(60):
        words = (docs[i % 12][1] or "").split()
        words[random.randrange(len(words))] = "changed"
        docs.append((1000 + i, " ".join(words)))
    docs += [(2000, None), (2001, ""), (2002, "\n"), (2003, "One two"), (2004, "one TWO"), (2005, "x " * 9000)]
    random.shuffle(docs)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, str(tmp_path)).collect()}
    docs.sort()
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = roots_of(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == {d: (f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, roots)}


def test_fingerprints_within_the_radius(spark):
    """Chains and balls of fingerprints, among them such as differ in exactly four and five bits."""
    random.seed(4)
    fps = {0, 1, (1 << 64) - 1, 0b11111, 0b1111 << 60}
    for _ in range(25):
        x = random.getrandbits(64)
        for _ in range(random.randint(1, 15)):
            fps.add(x)
            for _ in range(random.randint(1, 5)):
                x ^= 1 << random.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    got = {r.fp % (1 << 64): r.root for r in simhash.near_groups(df).collect()}
    roots = roots_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    sides = collections.defaultdict(set)
    for f, r in zip(fps, roots):
        sides[r].add(got[f])
    assert all(len(s) == 1 for s in sides.values()) and len(sides) == len(set(got.values()))


def test_one_of_each_group_stays(spark, nasty):
    kept = simhash.keep_one(nasty)
    assert kept.columns == nasty.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert simhash.keep_one(nasty.where("1 = 0")).count() == 0
    assert simhash.near_duplicates(nasty.where("1 = 0")).count() == 0


def test_repeats_by_brute_force(spark):
    random.seed(5)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    few = "a b c d e f g".split()
    rows += [(100_000 + i, " ".join(random.choice(few[:k]) for _ in range(n))) for i, (k, n) in enumerate(
        [(1, 120), (1, 70), (2, 300), (2, 400), (3, 300), (1, 49), (1, 50), (2, 900)])]
    long = [random.choice(few) + str(random.randint(0, 99)) for _ in range(300)]
    for i in range(40):
        a = random.randint(0, 240)
        rows.append((200_000 + i, " ".join([f"x{i}{random.random()}" for _ in range(random.randint(0, 30))] + long[
            a:a + random.randint(45, 70)] + ["tail"] * random.randint(0, 60))))
    rows += NASTY + [(None, rows[5][1]), (5, rows[7][1]), (5, rows[7][1])]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("own")).repartition(3)
    got = substrings.remove_repeats(docs).collect()
    assert sorted(map(repr, helpers.cut_repeats(rows))) == sorted(repr((
        r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in got)
    assert substrings.remove_repeats(docs.where("1 = 0")).count() == 0


def test_equal_passages_get_equal_symbols():
    import numpy as np
    rng = np.random.default_rng(1)
    passage, salt = rng.integers(1, 50, 200).astype(np.uint64), rng.integers(50, 99, 100).astype(np.uint64)
    seen = []
    for before in (salt[:13], salt[40:90]):
        tokens = np.concatenate([[0], before, passage, before, [0]]).astype(np.uint64)
        walls = np.zeros(len(tokens), bool)
        walls[[0, -1]] = True
        name, _, _, low, high = substrings.recompress(tokens, walls)
        start = 1 + len(before)
        inside = (low >= start) & (high <= start + len(passage))
        seen.append(set(zip(name[inside].tolist(), (low[inside] - start).tolist())))
    assert seen[0] == seen[1] and seen[0]


def edited(s):
    i, c, k = random.randrange(len(s) + 1), random.choice("xyz😀 "), random.randrange(3)
    return s[:i] + c + s[i:] if k == 0 else s[:i] + s[i + 1:] if k == 1 else s[:i] + c + s[i + 1:]


def test_lines_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    random.seed(4)
    base = ["".join(random.choice("ab é😀cdefgh") for _ in range(random.randint(15, 60))) for _ in range(12)]
    rows = []
    for i in range(90):
        own = []
        for _ in range(random.randint(0, 6)):
            x = random.choice(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                x = edited(x)
            own.append(x)
        own.append(random.choice(["", " ", "short", f"Page {random.randint(1, 300):06d} of the whole long thing"]))
        rows.append((i, "\n".join(own) + f"\n{i}"))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "z" * 3000 + "\n" + "z" * 2999), (504, "z" * 2998 + "y"),
             (None, "last of all lines, which has no id\n" + base[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("hash", F.lit("own")).repartition(3)
    got = lines.dedup_lines(docs).collect()
    assert sorted(map(repr, helpers.dedup_lines(rows))) == sorted(
        repr((r.doc_id, r.n_lines, r.n_removed, r.kept or "")) for r in got)


def classes_of(n, pairs):
    """The least member of each one's class."""
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_crowded_lines_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    monkeypatch.setattr(lines, "LEAF", 3)
    random.seed(21)
    letters = lambda n: "".join(random.choice("abcdé😀 ") for _ in range(n))
    texts = {letters(30) for _ in range(10)}
    for base in (letters(24), letters(41), letters(95), letters(200)):
        for _ in range(70):
            x = base
            for _ in range(random.choice([0, 1, 1, 2, 2, 3, 4])):
                x = edited(x)
            texts.add(x)
    texts |= {f"order {i:04d} of the day was sent out" for i in range(0, 2000, 37)}
    texts |= {f"{i % 7}{i // 7 % 7} at both ends of a line {i // 49}{i % 5}" for i in range(0, 300, 4)}
    texts |= {"a" * n for n in range(20, 40)} | {"a" * n + "b" + "a" * (30 - n) for n in range(0, 31, 3)}
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, line string").withColumn("n", F.char_length("line"))
    got = {(r.u, r.v) for r in lines.near_pairs(df).collect()}
    near = {(i, j) for j in range(len(texts)) for i in range(j)
            if min(len(texts[i]), len(texts[j])) >= 18 and helpers.few_edits(texts[i], texts[j])}
    assert got <= near
    assert classes_of(len(texts), got) == classes_of(len(texts), near)


def test_large_crowds_are_linked_in_proportion(spark):
    rows = [(i, f"record {i:05d} was written to the file of the day") for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, line string").withColumn("n", F.char_length("line"))
    got = [(r.u, r.v) for r in lines.near_pairs(df).collect()]
    assert len(got) < 100 * len(rows) and len(set(classes_of(len(rows), got))) == 1


def test_lines_that_only_share_a_segment_are_not_paired(spark, monkeypatch):
    random.seed(4)
    letters = lambda n: "".join(random.choice("abcdefghiklmnoprstuvwy") for _ in range(n))
    rows = [(100 * g + i, f"{start}{letters(80)}") for g, start in enumerate(letters(40) for _ in range(8)) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, line string").withColumn("n", F.char_length("line"))
    made, write = [], lines.staged

    def counted(table, purpose):
        out = write(table, purpose)
        made.append((purpose, out.count()))
        return out

    monkeypatch.setattr(lines, "staged", counted)
    assert lines.near_pairs(df).count() == 0
    assert sum(n for purpose, n in made if purpose == "lines-pairs") < len(rows)


def test_crowded_lines_that_are_not_near_are_not_paired(spark, monkeypatch):
    random.seed(8)
    letters = lambda n: "".join(random.choice("abcdefghiklmnoprstuvwy") for _ in range(n))
    mixed = lambda x: "".join(random.sample(x, len(x)))
    start, middle, end, made = letters(34), letters(8), letters(38), []
    # All have the same letters; twenty at a time differ in one place alone, by more than two edits.
    rows = [start + mixed("abcdefghik") + middle + place + end for place in [mixed("noprst") for _ in range(8)] for _ in range(20)]
    rows = list(enumerate(sorted({*rows, rows[0][:-9] + rows[0][-8:]})))
    df = spark.createDataFrame(rows, "id bigint, line string").withColumn("n", F.char_length("line"))
    pairs = lines._pairs

    def counted(found):
        out = pairs(found)
        made.append(out.count())
        return out

    monkeypatch.setattr(lines, "_pairs", counted)
    got = {(r.u, r.v) for r in lines.near_pairs(df).collect()}
    near = {(i, j) for j, b in rows for i, a in rows[:j] if helpers.few_edits(a[34:], b[34:])}
    assert near and got <= near and classes_of(len(rows), got) == classes_of(len(rows), near)
    assert sum(made) < len(rows)


def test_near_pairs_across_spans_of_lengths(spark):
    random.seed(5)
    texts = set()
    for n in [*range(22, 44), 95, 96, 97]:
        base = "".join(random.choice("abcdé😀 ") for _ in range(n))
        texts.add(base)
        for _ in range(7):
            x = base
            for _ in range(random.choice([1, 1, 2])):
                x = edited(x)
            texts.add(x)
    texts = sorted(x for x in texts if len(x) >= lines.NEAR_CHARS)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, line string").withColumn("n", F.char_length("line"))
    near = {(i, j) for j in range(len(texts)) for i in range(j) if helpers.few_edits(texts[i], texts[j])}
    assert {(r.u, r.v) for r in lines.near_pairs(df).collect()} == near


def test_lines_that_meet_are_picked_without_moving_the_rest(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    monkeypatch.setattr(lines, "LEAF", 3)
    rows = [(32768 * i, f"record {i:03d} was written to the file") for i in range(60)]
    rows += [((1 << 33) * (i + 1) + i, chr(97 + i) * 30) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, line string").withColumn("n", F.char_length("line"))
    plans, write = [], lines.staged

    def planned(table, purpose):
        plans.append((purpose, table._jdf.queryExecution().executedPlan().toString()))
        return write(table, purpose)

    monkeypatch.setattr(lines, "staged", planned)
    monkeypatch.setattr(lines, "discard", lambda *tables: None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lines.near_pairs(df).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got >= 59
    assert all("SortMergeJoin" not in plan for purpose, plan in plans if purpose == "lines-texts")
    assert not [plan for purpose, plan in plans if purpose == "lines-pairs" and "SortMergeJoin [id#" in plan]
    wanted = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 1 << 33, (1 << 33) + 1, (5 << 33) + 40000]
    every = sorted({*wanted, *range(0, 70000, 3), *((k << 33) + i for k in range(6) for i in (0, 1, 2, 8, 39999, 40000, 40001))})
    all_lines = spark.createDataFrame([(i, str(i), 1) for i in every], "id bigint, line string, n int")
    ids = spark.createDataFrame([(i,) for i in wanted], "id bigint")
    assert sorted(r.id for r in lines._picked(all_lines, ids).collect()) == wanted


def test_output_names_that_are_taken(nasty):
    for rows in (lines.dedup_lines(nasty), substrings.remove_repeats(nasty)):
        assert rows.columns[:len(nasty.columns)] == nasty.columns and "kept_" in rows.columns
        assert len({c.lower() for c in rows.columns}) == len(rows.columns) and rows.count() == len(NASTY)


def test_edit_automaton(spark):
    random.seed(9)
    pairs = []
    for _ in range(300):
        a = "".join(random.choice("abé😀") for _ in range(random.randint(1, 9)))
        b = a
        for _ in range(random.randint(0, 3)):
            b = edited(b) or "q"
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    for errors in (1, 2):
        rows = df.withColumn("near", lines.within(chars("a"), chars("b"), errors)).withColumn(
            "d", F.levenshtein("a", "b")).collect()
        assert all(r.near == (r.d <= errors) for r in rows)


def test_lines_of_nasty_rows(nasty):
    rows = lines.dedup_lines(nasty, out="left").collect()
    assert len(rows) == len(NASTY) and sum(r.left is None for r in rows) == 3
    assert [r.left for r in rows if r.doc_id == 4] == ["twice", "twice"]
    assert lines.dedup_lines(nasty.where("1 = 0")).count() == 0


def test_shards_are_even_and_keep_groups(spark, nasty, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = [(i, "copy") for i in range(200)] + [(1000 + i, f"t{i // 2}") for i in range(120)]
    rows += [(2000 + i, f"u{i}é") for i in range(200)] + [(1, None), (1, None), (None, ""), (None, "x")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    spread = collections.defaultdict(set)
    for r in got:
        spread[r.text_hash].add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 6 and max(map(len, spread.values())) <= 5
    assert sharding.shard_documents(nasty).count() == len(NASTY)
    assert sharding.shard_documents(nasty.where("1 = 0")).count() == 0


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    prose = [f"Tale {i} goes on and on. " + " ".join(f"w{i}x{k}" for k in range(70)) + ". And so it ends." for i in range(6)]
    bench = " ".join(f"b{k}" for k in range(14))
    other = "Another story. " + " ".join(f"z{k}" for k in range(60)) + ". It ends too."
    docs = [(i, t) for i, t in enumerate(prose)] + [(10, prose[0]), (11, "too short"), (12, None),
            (13, prose[1] + "\n" + other), (14, f"Some words before it. {bench}. " + prose[2].replace("w2", "v2"))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 11 and 12 fail the rules; 10 loses its only line and is an empty text then; 13 loses a line; 14 is contaminated.
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 10, 13]
    assert rows[10].text == "" and rows[13].text == other and rows[13].n_chars == len(rows[13].text)
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows.values())
    assert len(corpus_pipeline.STAGES) == 5


def test_one_document_of_each_group_stays(spark):
    random.seed(12)
    docs = []
    for _ in range(40):
        own = [f"w{random.randrange(10 ** 6)}" for _ in range(random.randint(150, 300))]
        for _ in range(random.randint(1, 4)):
            docs.append((len(docs), " ".join(own)))
            own[random.randrange(len(own))] = f"x{len(docs)}"
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", " \n", "One two", "one TWO", docs[3][1].upper()])]
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = roots_of(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    shuffled = random.sample(docs, len(docs)) + [(None, docs[0][1]), (None, "alone and without an id at all")]
    df = spark.createDataFrame(shuffled, "doc_id bigint, text string").withColumn("_row", F.lit("own")).repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {docs[r][0] for r in roots} | {None}
