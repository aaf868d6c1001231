"""Operators that look at each text by itself: tokens, contamination, personal data, rules and classifiers."""

import base64
import hashlib
import random
import re
import zlib

import helpers
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonedeck.llm import bpe, decontaminate, pii, quality_model, quality_rules, queries, toxicity
from zonedeck.llm.frames import id_text

NASTY = [(1, None), (1, None), (2, ""), (3, " \n\t "), (None, "no id"), (None, None), (4, "twice"), (4, "twice"),
         (5, "x" * 50_000), (6, "é漢😀 \x1c\x85  end"), (7, "a\n\n b  c\n"), (8, "word " * 20_000)]


@pytest.fixture(scope="module")
def nasty(spark):
    """Rows with nulls, repeats and long texts, and columns named like those the operators make."""
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("own") for c in (
        "token_ids", "n_words", "found", "score", "label", "fp", "kept", "_count_n_words", "lang")}).repartition(2)


@pytest.fixture(scope="module")
def empty(nasty):
    return nasty.where("1 = 0")


@pytest.fixture(scope="module")
def sample(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text").collect()]


# Tokens.

@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.public_vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same_tokens(codec, tokenizer, texts):
    for text, packed in zip(texts, codec.encode([t.encode() for t in texts])):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode_ordinary(text), text[:80]
        assert codec.decode(packed) == text.encode()


def test_memory_of_a_task_is_bounded():
    """Words that never come again: what a task keeps does not follow the text."""
    small = bpe.Codec(bpe.public_vocabulary())
    for start in range(0, 250_000, 10_000):
        small.encode([" ".join(f"a{i}" for i in range(start, start + 10_000)).encode()])
    assert len(small._young) + len(small._old) < 150_000


def test_tokens_equal_the_library(codec, tokenizer, sample):
    random.seed(1)
    alphabet = "abcdefthe  '\n\t\x1c\x85\xa0é漢字１２😀'sABC012!?​　"
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    long = ["a" * 3000 + "bé" * 2000, " " * 2000, "thethe" * 900, "ab" * 511, "<|endoftext|> x"]
    same_tokens(codec, tokenizer, [t for _, t in sample] + made + long)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_tokens_of_any_text(text):
    vocabulary = test_tokens_of_any_text.__dict__.setdefault("codec", bpe.Codec(bpe.public_vocabulary()))
    assert vocabulary.decode(vocabulary.encode([text.encode()])[0]) == text.encode()


def test_tokens_of_nasty_rows(nasty, empty):
    done = bpe.encode_documents(nasty, bpe.public_vocabulary(), decoded_col="decoded")
    rows = done.select("doc_id", "text", "token_ids", "token_ids_", "decoded").collect()
    assert len(rows) == len(NASTY)
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.token_ids == "own"
    back = bpe.decode_documents(done.select("doc_id", F.col("token_ids_").alias("ids"), "text"), bpe.public_vocabulary(), "ids")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.encode_documents(empty, bpe.public_vocabulary()).count() == 0


# Contamination.

def test_contamination_by_brute_force(spark, sample):
    random.seed(5)
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:12]
    items += [(900, "Alpha Beta, gamma"), (901, None), (None, "zz yy"), (902, ""), (900, "other text é"), (903, "... ??")]
    rows = sample[:40] + NASTY[:11] + [(100 + i, f"some {t} more") for i, (_, t) in enumerate(items[:8])]
    rows += [(None, "x alpha-beta\nGAMMA alpha other text É é"), (9, items[3][1][:60]),
             (10, f"q {items[3][1]} w {items[3][1]} {items[4][1]}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(map(repr, helpers.contaminated(rows, items)))
    for block in (1 << 20, 700):
        found = decontaminate.find_contamination(docs, benchmark, block_bytes=block).collect()
        assert expected == sorted(repr((r.doc_id, r.found.n_words, sum(s.end - s.start for s in r.found.spans), ",".join(
            r.found["items"]))) for r in found)
    clean = [r for r in helpers.contaminated(rows, items) if not r[2]]
    assert decontaminate.decontaminate(docs, benchmark).count() == len(clean)
    cut = decontaminate.decontaminate(docs, benchmark, action="cut").where("doc_id = 10").first().text
    assert cut == "q . w ."


def test_contamination_of_nasty_rows(spark, nasty, empty):
    benchmark = spark.createDataFrame([(1, "twice")], "item_id bigint, text string")
    kept = decontaminate.decontaminate(nasty, benchmark)
    assert kept.columns == nasty.columns and kept.count() == len(NASTY) - 2
    assert decontaminate.decontaminate(nasty, benchmark.limit(0)).count() == len(NASTY)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


# Personal data.

def spans(rows):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in rows)


def test_base_spans_equal_the_patterns(spark, sample, tmp_path):
    random.seed(4)
    alphabet = "0123456789.+-@() aé_😀%\n"
    rows = sample + NASTY[2:6] + [
        (5000 + i, "".join(random.choice(alphabet) for _ in range(random.randint(0, 80)))) for i in range(800)]
    rows += [(9002, "x@y.com_z@w.com a@b.c.d@e.f"), (9003, "1.2.3.4.5.6.7.8 0255.1.1.1 " + "9" * 42 + ".1.1.1"),
             (9004, "a" * 50_000 + "@"), (9005, "a@" + "b." * 10_000 + "c"), (9007, "7 " * 3000),
             (9006, "4111 1111 1111 1111 4111-1111-1111-1112"), (9008, " 4111111111111111" * 200), (9009, "+1 " * 2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted(repr((i, hashlib.sha256(spans(helpers.base_spans(t)).encode()).hexdigest())) for i, t in rows)
    assert expected == sorted(repr((r.doc_id, r.base_sha256)) for r in queries.op4_pii(spark, str(tmp_path)).collect())


def test_counts_of_base_spans_by_kind(spark, tmp_path):
    rows = [(1, "a@b.c d@e.f"), (2, "1.2.3.4"), (3, "4111 1111 1111 1111, 4111111111111111 +4111111111111111"), (4, "+49 30 1234567"),
            (5, None), (6, "a@b.c, 10.0.0.1, 10.0.0.2, +49 30 1234567, 4111 1111 1111 1111, d@e.f, 900.1.1.1")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {i: [sum(k == kind for k, _, _ in helpers.base_spans(t)) for kind in pii.KINDS] for i, t in rows}
    assert expected[6] == [2, 2, 1, 1]
    assert expected == {r.doc_id: [r.n_email, r.n_ip, r.n_card, r.n_phone] for r in queries.op4_pii(spark, str(tmp_path)).collect()}


def test_model_adds_spans_like_the_base_ones(spark):
    random.seed(6)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    rows = [(i, f"reach {digits(3)} or mail user{digits(2)}@mail{digits(1)}.example.com now") for i in range(150)]
    rows += [(200 + i, f"call +1 ({digits(3)}) {digits(3)}-{digits(4)} today") for i in range(150)]
    rows += [(400 + i, f"key AK{digits(12)}Z and {digits(16)}x then 900.1.1.{digits(3)}") for i in range(150)]
    rows += [(999, "write to jane.doe (at) mail1.example.com please"), (1000, "nothing of the kind 12 34")]
    found = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[999].added] == [(1, 9, 40)]
    assert not found[1000].added and not found[1000].base and not found[450].added


def all_spans(text):
    """Base spans and everything that the looser patterns propose, kind by kind."""
    base = helpers.base_spans(text)
    found = {(k, a, b) for k, a, b in base}
    for m in re.finditer(r"\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9])+", text):
        n = sum(c in "0123456789" for c in m[0])
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m[0]):
            kinds = ["ip"]
        else:
            kinds = ["card"] * (12 <= n <= 19) + ["phone"] * (7 <= n <= 15)
        glued = re.search("[A-Za-z0-9]$", text[:m.start()]) or re.match("[A-Za-z0-9]", text[m.end():])
        for kind in kinds:
            if not glued and not any(k == kind and a <= m.start() and b >= m.end() for k, a, b in base):
                found.add((kind, m.start(), m.end()))
    for m in re.finditer(r"[A-Za-z0-9._%+-]+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]+)+", text):
        if not re.search("[A-Za-z0-9]$", text[:m.start()]) and not re.match("[A-Za-z0-9]", text[m.end():]):
            found.add(("email", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))


def test_proposals_by_brute_force(spark, monkeypatch, tmp_path):
    """With a model that takes everything, the spans are the base spans and all proposals."""
    monkeypatch.setattr(pii, "fit", lambda found, most=0: ("1.0D", 0.0))
    random.seed(44)
    alphabet = "0123456789012345678901234567890123456789.+-() aé_/"
    texts = ["ring 0049 30 1234567 or 0044 20 7946 0958.", "+49 30/1234567", "4111 1111 1111 1111", "4111 1111 1111 1112",
             "192.168.100.200 and 999.1.2.3", "joe (at) mail [dot] org", "+1 (319) 555-5132", "id 20240115123000x"]
    texts += ["".join(random.choice(alphabet) for _ in range(random.randint(0, 70))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    assert got == {i: all_spans(t) for i, t in enumerate(texts)}


def test_numbers_without_a_plus_are_decided_by_the_trees(spark):
    """Planted phone numbers in the words of real ones are added, order numbers that look alike are not."""
    random.seed(45)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    rows = [(i, f"please phone +49 {digits(2)} {digits(7)} today") for i in range(200)]
    rows += [(300 + i, f"order number {digits(16)} and {digits(18)}z") for i in range(200)]
    rows += [(600, "please phone 0049 30 1234567 today"), (601, "please phone 0044 20 7946 0958 today")]
    found = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [s.kind for s in found[600].added] == [4] and [s.kind for s in found[601].added] == [4]
    assert sum(len(found[300 + i].added) for i in range(200)) <= 4


def test_model_sees_every_labelled_candidate(spark):
    docs = spark.range(0, 21_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("mail u"), "id", F.lit("@example.com or 900.1.1."), F.col("id") % 7).alias("text"))
    seen = pii.training_rows(pii.candidates(docs))
    found = {(r.label, r.kind): r.n for r in seen.groupBy("label", "kind").agg(F.sum("n").alias("n")).collect()}
    assert found[1.0, 1.0] == 21_000 and found[0.0, 2.0] == 21_000 and seen.count() < 500


def test_redaction(spark, nasty):
    rows = [(1, "é mail a.b@c.org or +1 (319) 555-5132, host 10.0.0.1."), (2, None), (3, "plain"), (4, "+4111 1111 1111 1111")]
    done = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.redacted for r in done} == {
        1: "é mail [email] or [phone], host [ip].", 2: None, 3: "plain", 4: "+[card]"}
    kept = pii.redact(nasty)
    assert kept.columns == [*nasty.columns, "redacted"] and kept.count() == len(NASTY)


def test_personal_data_of_empty_tables(spark, empty):
    assert pii.find_spans(empty).count() == 0


# Rules.

def test_counts_by_brute_force(sample):
    counter = quality_rules.Counter()
    for text in [t for _, t in sample] + ["", "a b c a b c", "a a a a a", "x\nx\n\nx y\nx y", "# $ é|é"]:
        words = helpers.WORDS.findall(text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if helpers.WORDS.search(x)]
        got = dict(zip(quality_rules.COUNTS, counter.count(text.encode())))
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == len(inside)
        if len(words) > 3000:
            break


def test_estimated_accuracies_decide():
    # Two rules that agree outvote one that mostly votes against them.
    good, bad, off = 2, 0, 1
    code = lambda *v: sum(x * 3 ** k for k, x in enumerate(v))
    found = quality_rules.posteriors({code(good, good, bad): 500, code(bad, bad, good): 300, code(good, good, good): 50,
                                      code(off, off, bad): 10}, 3)
    assert found[code(good, good, bad)] > 0.9 and found[code(bad, bad, good)] < 0.1


def test_rules_find_junk_and_keep_prose(spark, nasty, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.assess(docs).join(labels, "doc_id").where("n_words >= 50").select("quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.98
    kept = quality_rules.keep_good(nasty)
    assert kept.columns == nasty.columns and kept.count() == quality_rules.assess(nasty).where("kept").count() == 0
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.assess(empty).count() == 0


# Classifiers.

def labelled(spark, label, allowed):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", label)
    return [(r.text.encode(), r[label]) for r in rows.collect() if allowed(zlib.crc32(str(r.doc_id).encode()))]


def test_quality_on_held_out_rows(spark):
    rows = labelled(spark, "quality", lambda c: c % 4 != 2)
    net = quality_model.train(rows[:1500], sum(y for _, y in rows) / len(rows))
    held = labelled(spark, "quality", lambda c: c % 4 == 2)
    right = (quality_model.score(net, [t for t, _ in held]) >= 0.7) == np.array([y == 1 for _, y in held])
    assert right.mean() > 0.93


def test_gradients_of_the_network():
    net, texts = quality_model.Network.fresh(3), [b"some text to learn from" * 20, b"", b"abc", b"other words here " * 9]
    net.weights[:] = np.random.default_rng(1).normal(size=net.weights.shape)
    wanted, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        p = quality_model.score(net, texts)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    for a, d in zip(net.arrays(), quality_model._gradients(net, texts, wanted, weight)):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old = a[at]
        a[at] = old + 1e-3
        high = loss()
        a[at] = old - 1e-3
        slope = (high - loss()) / (float(np.float32(old + 1e-3)) - float(np.float32(old - 1e-3)))
        a[at] = old
        assert abs(slope - d[at]) < 0.05 * abs(d[at]) + 1e-4


def test_scores_do_not_hang_on_neighbours():
    net = quality_model.Network.fresh(5)
    net.weights[:] = 1
    texts = [b"abc" * 100, b"", b"zz", b"q" * 5000]
    alone = [quality_model.score(net, [t])[0] for t in texts]
    assert np.allclose(quality_model.score(net, texts), alone)


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(spark, "toxic", lambda c: c % 5 != 0)
    model = toxicity.train(rows, sum(y for _, y in rows) / len(rows))
    held = labelled(spark, "toxic", lambda c: c % 5 == 0)
    score = toxicity.noisy_or(*model.logits([t for t, _ in held]))
    assert np.mean((score >= 0.5) == np.array([y == 1 for _, y in held])) > 0.93


def test_offending_sentences_are_located(spark, nasty, empty):
    good, bad = "The é weather is fine today", "You are a moron and scum"
    sample = [(f"{good}. {good} {i}.".encode(), 0) for i in range(60)] + [
        (f"{good} {i}. {bad}. {good}.".encode(), 1) for i in range(60)]
    model = toxicity.train(sample, 0.5)
    docs = spark.createDataFrame([(1, f"{good}. {bad}! {good}"), (2, good)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in toxicity.with_toxicity(docs, model).collect()}
    text = f"{good}. {bad}! {good}"
    assert [text[s.start:s.end].strip() for s in rows[1].offending] == [bad] and rows[1].score > 0.5
    assert rows[2].score < 0.5 and not rows[2].offending
    scored = toxicity.with_toxicity(nasty, model)
    assert scored.count() == len(NASTY) and scored.where("text is null and score_ <> 0").count() == 0
    assert toxicity.with_toxicity(empty, model).count() == 0


def test_scores_without_labels(spark, nasty, empty):
    none = spark.createDataFrame([(None, 1), (4, None)], "doc_id bigint, quality int").withColumn("toxic", F.col("quality"))
    for scored in (quality_model.score_documents(nasty, none), toxicity.score_documents(nasty, none)):
        rows = scored.collect()
        assert len(rows) == len(NASTY) and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert quality_model.score_documents(empty, none).count() == 0
    assert id_text(nasty).columns == ["doc_id", "text"]


def test_network_by_plain_loops():
    """Responses at every byte, chunk by chunk, without the layout the network works on."""
    random.seed(41)
    net = quality_model.Network.fresh()
    rng = np.random.default_rng(5)
    net.bias, net.weights = rng.normal(0, 0.3, 24).astype(np.float32), rng.normal(0, 1, 48).astype(np.float32)
    texts = [b"", b"a", b"abcde", b"abcdefghA", b"abcdefghZ"] + [
        bytes(random.randrange(256) for _ in range(random.choice([3, 122, 123, 124, 128, 129, 250, 700]))) for _ in range(25)]
    got = quality_model.score(net, texts)
    for text, value in zip(texts, got):
        padded = text + bytes(quality_model.WIDTH - 1)
        hops = max(1, -(-len(padded) // quality_model.HOP))
        tops = np.zeros((hops, 24))
        for p in range(len(text)):
            seen = np.concatenate([net.embedding[b] for b in padded[p:p + quality_model.WIDTH]])
            tops[p // quality_model.HOP] = np.maximum(tops[p // quality_model.HOP], seen @ net.filters + net.bias)
        chunks = np.array([np.maximum(a, b) for a, b in zip(tops, tops[1:])]) if hops > 1 else tops
        z = np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.weights
        assert abs(value - 1 / (1 + np.exp(-z))) < 1e-5
    assert got[3] != got[4] and len({round(float(x), 6) for x in got[:3]}) == 3


def test_noisy_or_by_plain_loops():
    """Words add up to a sentence's odds, sentences to a document's probability, one after the other."""
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(0, 0.4, toxicity.WEIGHTS), -3.0)
    texts = ["", "...", "One bad word. And a good one!\nThird line", "É漢 word? word", "a " * 300 + ". b"]
    z, counts = model.logits([t.encode() for t in texts])
    got = toxicity.noisy_or(z, counts)
    for text, value in zip(texts, got):
        clean = 1.0
        for sentence in "".join("\n" if c in ".!?\n\r" else c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " "
                                for c in text).split("\n"):
            odds = 0.0
            for word in sentence.split():
                marked = b"^" + word.encode() + b"$"
                places = {zlib.crc32(marked) % toxicity.WEIGHTS}
                for n in (4, 5):
                    places |= {zlib.crc32(marked[i:i + n], n) % toxicity.WEIGHTS for i in range(len(marked) - n + 1)}
                odds += np.exp(sum(model.weights[i] for i in places))
            if odds:
                clean *= 1 - 1 / (1 + 1 / (np.exp(-3.0) * odds))
        assert abs(value - (1 - clean)) < 1e-9
