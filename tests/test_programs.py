"""Program analysis, retrieval, training text and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonedeck.functions import patterns as P
from zonedeck.operators import cells
from zonedeck.operators import programs as S
from zonedeck.operators import retrieve as R
from zonedeck.operators import training as T
from zonedeck.sources.corpus import load_corpus, load_knowledge, load_programs, store_programs
from zonedeck.streaming import feeds

CICS = "       EXEC CICS READ\n           FILE('CUSTOMER')\n       END-EXEC\n"
PACKED = "    01 TXN-REC.\n       05 AMT PIC S9(9)V99 COMP-3.\n"


def corpus(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


@pytest.mark.parametrize("text,cics,vsam", [
    (CICS + "01 R PIC 9(4) COMP.", True, False), (PACKED, False, True), (CICS + PACKED, True, True),
    ("COMPUTE X = 100.", False, False), ("FD CUSTOMER-FILE RECORDING MODE F.\n01 C PIC X(80).", False, True),
    ("exec cics syncpoint end-exec", True, False)])
def test_detection(spark, text, cics, vsam):
    row = S.detect_constructs(corpus(spark, text)).first()
    assert (row.cics, row.vsam) == (cics, vsam)


def test_repeated_block_is_replaced_where_it_stands(spark):
    line = "EXEC CICS RETURN END-EXEC"
    df = corpus(spark, f"A\n{line}\nB\n{line}\nC", "nothing here")
    out = S.substitute_blocks(df, spark.createDataFrame([(line, "raise Done()")], "original string, translated string"))
    rows = {r.path: r.enriched for r in out.collect()}
    stub = f"{P.STUB_OPEN}\n# Original: {line}...\nraise Done()\n{P.STUB_CLOSE}"
    assert rows == {"0": f"A\n{stub}\nB\n{stub}\nC", "1": "nothing here"}


def test_untranslated_block_stays(spark):
    none = spark.createDataFrame([], "original string, translated string")
    assert S.substitute_blocks(corpus(spark, CICS), none).first().enriched == CICS


def test_last_record_and_strict(spark):
    text = "01 A PIC X.\n01 B.\n   05 C PIC 9(5) COMP-3.\nPROCEDURE DIVISION.\n   MOVE A TO B.\n"
    loose = [r.original for r in S.extract_records(corpus(spark, text)).collect()]
    strict = [r.original for r in S.extract_records(corpus(spark, text), strict=True).collect()]
    assert loose == [text[text.index("01 B"):]]
    assert strict == ["01 B.\n   05 C PIC 9(5) COMP-3.\n"]


def test_tags(spark):
    df = S.tag_rules(corpus(spark, "COMPUTE X ROUNDED = Y", "PERFORM payroll", "é PIC ", "ePICé", "copy book"))
    got = {r.path: r.tags for r in df.collect()}
    assert got == {"0": ["decimal_precision", "compute"], "1": ["decimal_precision", "perform", "payroll_patterns"],
                   "2": ["decimal_precision", "pic_clause"], "3": ["decimal_precision"], "4": ["decimal_precision", "copy_books"]}


def plain_tags(df, rules, always=None):
    """Every pattern tried on every text."""
    first = [F.lit(always)] if always else []
    return df.select("path", F.array_distinct(F.array_compact(F.array(*first, *[
        F.when(F.col("text").rlike(p), F.lit(t)) for p, t in rules]))).alias("tags"))


NASTY_TEXTS = ["", "if", "IF_X", "x-if.", "\u017ftop run", "di\u017fplay", "D\u0131V\u0130DE", "ﬀ IF", "IFé", "é-IF-é", "COMP-3x", "COMP-3",
               "procedure\ndivision", "aPROCEDURE DIVISION PROCEDURE DIVISION", "PROCEDURE DIVISIONs", "xgross pay", "net\npay",
               "packedx", "un-packed", "a\tb\x00if\x7felse", "compu\u212ate", "STOP RUN_", "STOP  RUN", "working-storage1 working-storage"]


def test_word_check_never_changes_a_tag(spark):
    assert S._words(r"(?iU)\bIF\b|\bELSE\b|\bA B\b") == ["IF", "ELSE"] and S._words(r"(?iU)\b(loan|tax)\b") == ["LOAN", "TAX"]
    assert S._alternatives(r"(?i)x?y") is None and S._alternatives(r"COMPUTE") is None and S._alternatives(r"(?i)a|.b") is None
    words = [w for p, _ in P.KEYWORD_RULES for w in S._words(p)]
    texts = words + [f"{w}s {w}" for w in words] + [f"_{w}" for w in words] + NASTY_TEXTS
    df = corpus(spark, *texts, None)
    assert S.tag_rules(df).select("path", "tags").exceptAll(plain_tags(df, P.KEYWORD_RULES, P.ALWAYS_TAG)).count() == 0


def test_rule_table_equals_rule_list(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_RULES", 3)
    rules = [(p, t) for p, t in P.KEYWORD_RULES if t != P.ALWAYS_TAG] + [
        (r"(?iU)\b(if|loan|perform)\b", "if_evaluate"), (r"x.*y", "wide"), (r"(?i)\bif\b", "ascii"), (r"[é]", "accent")]
    table = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rules)] + [(99, None, "none")],
                                  "ord int, pattern string, tag string").repartition(3)
    texts = NASTY_TEXTS + ["perform loan", "PERFORM x and y", None] + ["if copied text"] * 40
    df = corpus(spark, *texts).repartition(4)
    got = {r.path: r.tags for r in S.tag_rules(df, table, always=None).collect()}
    assert got == {r.path: r.tags for r in plain_tags(df, rules).collect()}
    assert {r.tags[0] for r in S.tag_rules(df, table.limit(0), always="all").collect()} == {"all"}


def test_rule_table_of_many_rules(spark):
    """Far more rules than a plan could hold; each text meets only those whose words it has."""
    rules = spark.range(30_000).select("id", F.concat(F.lit(r"(?iU)\bw"), "id", F.lit(r"\b")).alias("pattern"),
                                       F.concat(F.lit("t"), F.col("id") % 1000).alias("tag")).withColumnRenamed("id", "ord")
    df = corpus(spark, "w29999 w5 W1005 w7x", "é w12 éw13", "nothing")
    got = {r.path: r.tags for r in S.tag_rules(df, rules, always=None).collect()}
    assert got == {"0": ["t5", "t999"], "1": ["t12"], "2": []}


def test_census_of_nested_layout(spark):
    text = ("       01 REC.\n          05 A PIC X(3).\n          05 G OCCURS 2 TIMES.\n             10 H OCCURS 3 TIMES.\n"
            "                15 I PIC 9(5) COMP-3.\n             10 J PIC X.\n          05 K PIC X.\n       01 NEXT-ONE PIC X(9).\n")
    got = {r.name: (r.offset, r.width) for r in S.layout_census(corpus(spark, text)).collect()}
    assert got == {"REC": (0, None), "A": (0, 3), "G": (3, None), "H": (3, None), "I": (3, 3), "J": (12, 1), "K": (23, 1), "NEXT-ONE": (0, 9)}


def fields_by_hand(statements):
    """Places of the fields of ``(level, name, width or None for a group, occurs, redefines)``, with a stack."""
    record, first, at, stack, out = "", 0, 0, [], []
    for level, name, width, occurs, redefines in statements:
        while stack and (stack[-1]["level"] >= level or level in (1, 77)):
            g = stack.pop()
            at = g["resume"] if g["resume"] is not None else g["start"] + (at - g["start"]) * g["occurs"]
        if level in (1, 77):
            record, first, at = name, len(out), 0
        start = at
        if redefines:
            start = next((o[3] for o in reversed(out[first:]) if o[1] == redefines), at)
        out.append((record, name, redefines, start, None if width is None else width * occurs))
        if width is None:
            stack.append({"level": level, "start": start, "occurs": occurs, "resume": at if redefines else None})
            at = start
        elif not redefines:
            at += width * occurs
    return out


def test_census_by_hand(spark):
    """Random layouts with nested groups, repeats, overlays of anything before, and names that come again."""
    import random

    random.seed(31)
    texts, expected = [], {}
    for path in range(150):
        statements, lines = [], []
        for i in range(random.randint(1, 40)):
            level = 1 if i == 0 and random.random() < 0.8 else random.choice([1, 5, 5, 10, 10, 10, 15, 15, 77, 20])
            name = f"N{random.randint(0, 12)}"
            width = random.choice([None, 1, 3, 8])
            occurs, redefines = random.choice([1, 1, 1, 2, 3]), random.choice(["", "", "", f"N{random.randint(0, 12)}"])
            statements.append((level, name, width, occurs, redefines))
            lines.append(f"       {level:02d}  {name}" + (f" REDEFINES {redefines}" if redefines else "")
                         + (f" OCCURS {occurs} TIMES" if occurs > 1 else "") + (f" PIC X({width})" if width else "") + ".")
            if random.random() < 0.1:
                lines.append("       88  YES VALUE 'Y'.")
        texts.append("\n".join(lines) + "\n")
        expected[str(path)] = fields_by_hand(statements)
    got = {}
    for r in S.layout_census(corpus(spark, *texts)).orderBy("line").collect():
        got.setdefault(r.path, []).append((r.record, r.name, r.redefines, r.offset, r.width))
    assert got == expected


def test_census_of_a_long_record(spark):
    text = "       01 REC.\n" + "".join(f"          05 F{i} PIC X({i % 9 + 1}).\n" for i in range(5000))
    last = S.layout_census(corpus(spark, text)).where("name = 'F4999'").first()
    assert last.offset == sum(i % 9 + 1 for i in range(4999))


def test_corpus_analysis_does_not_shuffle(spark):
    df = corpus(spark, CICS + PACKED)
    for job in (S.detect_constructs, S.tag_rules, S.extract_blocks, S.extract_records, S.segment_summary, S.layout_census):
        plan = job(df)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, job.__name__


def test_load_corpus(spark, tmp_path):
    (tmp_path / "a.cob").write_text("line 1\nline 2\n")
    (tmp_path / "b.cob").write_text("other")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in load_corpus(spark, f"{tmp_path}/*.cob").collect()} == {
        "a.cob": "line 1\nline 2\n", "b.cob": "other"}


def test_many_programs_in_few_files(spark, tmp_path):
    """Splits cut files anywhere; programs come back whole, with empty ones and all line ends."""
    rows = [("", ""), ("a b", "\n"), ("c", "line\r\n\n x \x1e\n"), ("é", "漢😀"), ("last", "\x1d")]
    rows += [(f"p{i}", f"       PROGRAM {i}.\n" * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    store_programs(df, str(tmp_path / "s"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        back = load_programs(spark, str(tmp_path / "s"))
        assert back.rdd.getNumPartitions() > 50 and len(list((tmp_path / "s").glob("part-*"))) == 3
        assert sorted(map(tuple, back.collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for key, text in (("a\nb", "x"), ("k", "x\x1e\x1d\ny"), (None, "x"), ("k", None)):
        with pytest.raises(Exception, match="cannot be stored"):
            store_programs(spark.createDataFrame([(key, text)], "path string, text string"), str(tmp_path / f"bad{key}{text is None}"))


def test_load_knowledge_refuses_repeats(spark, tmp_path):
    line = '{"id": "a", "topic": "t", "tags": ["x"], "text": "a text that is long enough"}\n'
    (tmp_path / "ok.json").write_text(line)
    assert load_knowledge(spark, str(tmp_path / "ok.json")).count() == 1
    (tmp_path / "bad.json").write_text(line * 2)
    with pytest.raises(ValueError, match="repeated_ids"):
        load_knowledge(spark, str(tmp_path / "bad.json"))


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of very unequal size, exact copies, and a zero vector."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 16))
    rows = [centres[min(4, int(rng.exponential(1.0)))] + rng.normal(scale=0.1, size=16) for _ in range(900)]
    rows += [rows[0]] * 300 + [np.zeros(16)]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id bigint, vector array<double>")


def brute_force(rows, k):
    matrix = np.array([r.vector for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    order = np.argsort(np.round(1 - unit @ unit.T, 9), axis=1, kind="stable")[:, :k]
    return {rows[i].id: [rows[j].id for j in order[i]] for i in range(len(rows))}


@pytest.mark.parametrize("limit", [R.MATRIX_BYTES, 16 * 8 * 50])
def test_nearest_equals_brute_force(spark, vectors, limit):
    expected = brute_force(vectors.orderBy("id").collect(), 4)
    got = R.nearest_lists(vectors.withColumnRenamed("id", "query_id"), vectors, 4, matrix_bytes=limit)
    assert {r.query_id: [n.id for n in r.neighbours] for r in got.collect()} == expected


def test_cells_leave_out_what_cannot_matter(spark):
    """On clustered vectors fewer than a fifth of the cells, and of the vectors, are compared; the result is exact."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(scale=0.15, size=32)]) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = vectors.select(F.col("id").alias("_qid"), F.col("vector").alias("_vec"))
    best, more, index = cells.search_plan(asked, vectors, 4, 4000, 32, "vector", "id", 32 * 8 * 200)
    got = {}
    for r in best.orderBy("_qid", "_rank").collect():
        got.setdefault(r["_qid"], []).append(r["_vid"])
    assert got == brute_force(vectors.orderBy("id").collect(), 4)
    counts = F.array(*[F.lit(int(n)) for n in index.counts])
    compared = more.select(F.size("_cells").alias("n"), F.aggregate("_cells", F.lit(0), lambda s, c: s + F.get(counts, c)).alias("v"))
    share = compared.agg(F.avg("n"), F.avg("v")).first()
    assert len(index.pivots) > 100 and share[0] < 0.2 * len(index.pivots) and share[1] < 0.2 * 4000


def test_vectors_no_bound_rules_out_are_scanned(spark, monkeypatch):
    """Queries that would go to most cells are not sent there; the scan agrees with brute force, copies and zeros included."""
    rng = np.random.default_rng(8)
    rows = np.round(rng.normal(size=(900, 24)), 3)
    rows[700:800], rows[800:820] = rows[0], 0.0
    rows[820:840] = 3 * rows[20:40]
    ids = rng.permutation(900).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rows)], "id bigint, vector array<double>").repartition(5)
    sent = []
    search = cells._search
    monkeypatch.setattr(cells, "_search", lambda asked, *rest: sent.append(asked.count()) or search(asked, *rest))
    monkeypatch.setattr(cells, "TRIAL", 20)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 24 * 8 * 150)
    asked = df.select(F.struct("id", F.lit("x").alias("s")).alias("_qid"), F.col("vector").alias("_vec"))
    found, _, _ = cells.search_plan(asked, df, 7, 900, 24, "vector", "id", 24 * 8 * 150)
    got = {}
    for r in found.collect():
        got.setdefault(r._qid.id, {})[r._rank] = r._vid
    assert sent == [20]
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    unit = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
    distance = np.round(1 - unit @ unit.T, 9)
    for q, i in enumerate(ids):
        nearest = sorted(zip(distance[q].tolist(), ids))[:7]
        assert [got[i][r] for r in range(1, 8)] == [v for _, v in nearest], i


@pytest.mark.parametrize("limit", [64, 16 * 8 * 20, 16 * 8 * 400])
def test_cells_of_any_size(spark, vectors, limit):
    """Blocks of a few vectors, queries from outside, vectors without a direction on either side."""
    rows = vectors.orderBy("id").collect()
    some = vectors.where("id % 7 = 0 or id = 1200").unionByName(spark.createDataFrame(
        [(5000 + i, [float(i + j) for j in range(16)]) for i in range(3)] + [(6000, [0.0] * 16)], vectors.schema))
    everything = rows + [r for r in some.collect() if r.id >= 5000]
    matrix = np.array([r.vector for r in everything])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    got = R.nearest_lists(some.withColumnRenamed("id", "query_id"), vectors, 5, matrix_bytes=limit)
    place = {r.id: i for i, r in enumerate(everything)}
    for r in got.collect():
        distance = np.round(1 - unit[place[r.query_id]] @ unit[:len(rows)].T, 9)
        assert [n.id for n in r.neighbours] == [rows[j].id for j in np.argsort(distance, kind="stable")[:5]], r.query_id


def test_queries_without_a_vector(spark, vectors):
    asked = vectors.where("id < 40").selectExpr("id AS query_id", "CASE WHEN id % 3 > 0 THEN vector END AS vector")
    for limit in (1 << 20, 16 * 8 * 50):
        got = R.nearest_lists(asked, vectors, 4, matrix_bytes=limit, some_without=True).collect()
        expected = brute_force(vectors.orderBy("id").collect(), 4)
        assert len(got) == 40
        for r in got:
            assert (r.neighbours is None) == (r.query_id % 3 == 0)
            assert r.neighbours is None or [n.id for n in r.neighbours] == expected[r.query_id]


def test_nearest_with_fewer_vectors_than_k(spark, vectors):
    few = vectors.where("id < 3")
    got = R.nearest(few.withColumnRenamed("id", "query_id"), few, 5)
    assert got.count() == 9
    assert R.nearest(few.withColumnRenamed("id", "query_id"), few.limit(0), 5).count() == 0


def test_retrieve_order(spark):
    """Rule order for promoted notes the search returned, then distance; a promoted note it missed stays out."""
    vec = lambda a: [float(np.cos(a)), float(np.sin(a))]
    chunks = spark.createDataFrame([("near", vec(0.1)), ("compute", vec(0.3)), ("move", vec(0.2)), ("far", vec(3.0)), ("decimal_precision", vec(2.9))],
                                   "id string, vector array<double>")
    query = spark.createDataFrame([(1, "COMPUTE A. MOVE B.", vec(0.0))], "query_id int, text string, vector array<double>")
    assert R.retrieve(query, chunks, k=3).first().chunk_ids == ["decimal_precision", "compute", "move"]
    assert R.retrieve(query, chunks.where("id <> 'decimal_precision'"), k=1).first().chunk_ids == ["compute"]
    none = query.withColumn("text", F.lit("nothing"))
    assert R.retrieve(none, chunks, k=1).first().chunk_ids == ["near"]


def test_content_hash_ignores_row_order_only(spark):
    h = lambda rows: R.content_hash(spark.createDataFrame(rows, "id string, text string"), ["id", "text"]).first().content_hash
    assert len(h([("a", "x")])) == 64
    assert h([("a", "x"), ("b", "y")]) == h([("b", "y"), ("a", "x")])
    assert len({h([("a", "x")]), h([("ax", "")]), h([("a", "x"), ("a", "x")]), h([("a", None)])}) == 4


def test_refresh_plan_actions(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    old, new = frame([("a", "1"), ("b", "2"), ("c", "3")]), frame([("a", "1"), ("b", "x"), ("d", "4")])
    plan = lambda **o: {r.id: r.action for r in R.refresh_plan(new, old, "id", ["text"], **o).collect()}
    assert plan() == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}
    assert plan(force=True)["a"] == "update"


def test_prompts(spark):
    df = spark.createDataFrame([(["one", "two"],), ([],)], "notes array<string>")
    full, bare = [r.system_prompt for r in R.render_prompt(df, "BASE").collect()]
    assert bare == "BASE" and "[Rule 1] one\n\n[Rule 2] two\n" in full and full.endswith(R.RULES_TAIL)
    asked = spark.createDataFrame([("SRC", R.FIRST_REQUEST), ("SRC", "broken")], "text string, feedback string")
    first, again = [r.user_prompt for r in R.render_request(asked, feedback="feedback").collect()]
    assert "Feedback" not in first and again.endswith("Feedback from previous attempt (fix this):\nbroken")


def test_long_prompts(spark):
    df = spark.createDataFrame([("p " * 600, "p " * 600 + "o " * 10), ("p " * 1100, "p " * 1100 + "o ")], "prompt string, full_text string")
    fixed, reference = T.loss_spans(df).collect(), T.loss_spans(df, reference_mask=True).collect()
    assert [(r.kept_tokens, r.loss_tokens, r.prompt_leaks) for r in fixed] == [(610, 10, True), (1024, 0, True)]
    assert [r.loss_tokens for r in reference] == [98, 512]


def minutes(spark, first, last):
    return spark.range(first, last).select(
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 60).alias("ts"),
        F.when(F.col("id") % 3 == 0, "E").otherwise("A").alias("status"), F.col("id").cast("decimal(9,2)").alias("amount"))


def arriving(spark, source, slices):
    """Files that arrive one after the other, one per batch."""
    for first, last in slices:
        minutes(spark, first, last).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(minutes(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_stream_in_append_mode_equals_batch(spark, tmp_path):
    """Every window the watermark has passed equals the batch result."""
    stream = arriving(spark, str(tmp_path / "in"), [(0, 500), (500, 1000), (1000, 1500), (1500, 2000)])
    out = str(tmp_path / "out")
    feeds.control_totals_stream(stream, "ts", "status", "amount", out, str(tmp_path / "cp"), window="1 hour").awaitTermination()
    batch = feeds.windowed_totals(minutes(spark, 0, 2000), "ts", "status", "amount", window="1 hour")
    got = spark.read.parquet(out)
    assert 20 < got.count() <= batch.count() and got.exceptAll(batch).count() == 0


def test_partial_totals_count_late_rows(spark, tmp_path):
    """The oldest rows arrive last, far behind any watermark, and still count."""
    stream = arriving(spark, str(tmp_path / "in"), [(1000, 2000), (700, 1000), (0, 700)])
    out = str(tmp_path / "out")
    feeds.control_totals_partials(stream, "ts", "status", "amount", out, str(tmp_path / "cp"), window="1 hour").awaitTermination()
    batch = feeds.windowed_totals(minutes(spark, 0, 2000), "ts", "status", "amount", window="1 hour")
    got = feeds.read_totals(spark, out)
    assert got.count() == batch.count()
    assert got.join(batch, ["window_start", "record_count", "total_amount", "error_count"]).count() == batch.count()


def test_queue_is_read_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: feeds.consume_queue(spark.readStream.schema("id bigint").parquet(source), out, state).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 13).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 13
    assert feeds.queue_state(0) == 23


def test_a_run_of_many_batches_is_counted(spark, tmp_path):
    """More batches than Spark keeps progress for; a second run finds nothing, a third one what is new."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(0, 230, 1, 115).write.parquet(source)

    def run():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        done = feeds.consume_counted(stream, out, state)
        done.query.awaitTermination()
        return done

    first = run()
    assert len(first.query.recentProgress) <= 100 and first.batches[1] - first.batches[0] >= 114
    assert [feeds.taken(first), feeds.taken(run())] == [230, 0]
    spark.range(230, 233).write.mode("append").parquet(source)
    last = run()
    assert feeds.taken(last) == 3 and feeds.queue_state(feeds.taken(last)) == 0
    assert sorted(r.id for r in feeds.read_taken(spark, out).collect()) == list(range(233))


def test_closing_writes_the_open_windows(spark, tmp_path):
    source, closing, out, state = (str(tmp_path / x) for x in ("in", "closing", "out", "cp"))
    arriving(spark, source, [(0, 500), (500, 1000), (1000, 2000)])
    schema, runs = minutes(spark, 0, 1).schema, []

    def start():
        stream = feeds.with_closing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), closing)
        runs.append(feeds.control_totals_stream(stream, "ts", "status", "amount", out, state, window="1 hour"))
        return runs[-1]

    start().awaitTermination()
    batch = feeds.windowed_totals(minutes(spark, 0, 2000), "ts", "status", "amount", window="1 hour")
    before = spark.read.parquet(out).count()
    feeds.close_stream(spark, closing, schema, "ts", start)
    got = spark.read.parquet(out)
    assert before < batch.count() == got.count() and got.exceptAll(batch).count() == 0
    # Only the window of the closing rows is left in the state.
    assert runs[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_system_turns_of_a_conversation(spark, monkeypatch):
    """The last system turn before a turn counts, also in a conversation far longer than others; unanswered turns stay."""
    from zonedeck.operators import ordering

    monkeypatch.setattr(ordering, "KEY_ROWS", 30)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "system", "S1"), (1, 3, "user", "c"), (1, 4, "user", "d"),
            (1, 5, "system", "S2"), (1, 6, "user", "e"), (1, 7, "assistant", "f"), (2, 0, "system", "T"), (2, 1, "user", "x"),
            (2, 5, "user", "y"), (2, 6, "assistant", "z"), (3, 0, "assistant", "alone"), (None, 1, "user", "q")]
    rows += [(9, i, "system" if i % 7 == 0 else "user", f"t{i}") for i in range(90)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    names = ("conv_id", "turn", "role", "text")
    got = T.with_system(T.pair_turns(turns, *names, answered=False), turns, *names, "none").collect()
    expected = {(c, t): next((x for k, u, r, x in sorted(rows[:-91] + rows[-90:], key=lambda r: (r[0] or 0, -r[1])) if k == c and u < t and r == "system"), "none")
                for c, t, r, _ in rows if r == "user"}
    assert {(r.conv_id, r.turn): r.system for r in got} == expected
    assert {(r.conv_id, r.turn): r.output for r in got if r.output} == {(1, 0): "b", (1, 6): "f", (2, 5): "z"}
    counts = T.count_turns(turns, *names).first()
    assert (counts.answered, counts.unasked, counts.system_turns) == (3, 1, 16) and counts.unanswered == counts.asked - 3
    rendered = T.render_chat(T.with_system(T.pair_turns(turns, *names, answered=False), turns, *names, "none"), F.col("system"))
    assert rendered.where("output IS NULL AND full_text IS NOT NULL").count() == 0
    assert rendered.where("conv_id = 1 AND turn = 6").first().full_text == "<|system|>\nS2\n<|user|>\ne\n<|assistant|>\nf<|im_end|>"


def test_stored_programs_are_listed_by_folder(spark, monkeypatch):
    """One file for each program, found by one listing and not by a pattern that Spark looks up file by file."""
    from zonedeck.plans import program_jobs

    asked = []
    read = program_jobs.read_corpus
    monkeypatch.setattr(program_jobs, "read_corpus", lambda spark, at: asked.append(at) or read(spark, at))
    loaded = program_jobs.load_corpus(spark, "/root/testdata/sf0.001").collect()
    assert "*" not in asked[0] and loaded and len({r.path for r in loaded}) == len(loaded)
