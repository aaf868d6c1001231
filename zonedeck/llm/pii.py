"""Personal data: base patterns, candidate generators and a boosted model that adds spans.

Everything here is DataFrame and SQL functions; the model is Spark's own gradient-boosted trees, fitted on all labelled
candidates and scored as a SQL expression, so a text is scanned, scored and redacted where it is read.  Candidates with
equal features are one training row whose weight is their number, so only distinct features are shuffled and kept.

Base spans are the matches of four patterns that pass their checks.  Generators with looser patterns propose further
spans, which may overlap each other: runs of digits with any of the usual separators, as every kind that their number of
digits allows, and addresses with the signs spelt out.  Only what a passing base match of its kind covers is left out.  Trees over format (digits, groups, separators, checks) and context (keywords and signs before and after)
are trained with base matches that pass as positives; base matches that fail their check and proposals that are glued
to other letters or digits are the negatives.  Other proposals are not labelled: they are what the model decides on.
The threshold is the least score from which on at least ``PRECISION`` of a held-out third of them is positive.

Null texts count as empty and have no spans; very long texts are searched whole.  Rows are independent but for the model: repeated rows, null ids and
other columns pass through.  Without candidates of both kinds no span is added.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.llm.frames import free_name, staged

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, written so that Java neither backtracks nor recurses over long runs: within a run of characters
# of the first class only its start, or the end of the match before, can start a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns; a proposal's kind follows from its form.
NUMBERS = r"\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9])++"
SPELT = r"[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
#: Fewest digits of a number worth proposing.
LEAST_DIGITS = 7
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Trees, their depth, and the share of right ones among those selected.
TREES, DEPTH, PRECISION = 15, 3, 0.99
BEFORE, AFTER = 40, 20

_KEYWORDS = {
    "phone": "phone|call|tel|mobile|fax|contact", "card": "card|visa|credit|payment",
    "ip": "host|server|address|\\bip\\b", "mail": "mail|write|contact"}
FEATURES = ["kind", "digits", "length", "groups", "dots", "hyphens", "spaces", "brackets", "luhn", "octets", "at",
            "glued_before", "glued_after", "near_phone", "near_card", "near_ip", "near_mail", "digits_before"]


def _running(lengths: Column) -> Column:
    """Running totals of an array, in blocks of 64 so that long arrays cost far less than their square."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sums = F.transform(blocks, lambda b: total(F.slice(lengths, b * 64 + 1, 64)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), sums.alias("s")), lambda z: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(64), F.size(lengths) - z["b"] * 64)),
        lambda i: total(F.slice(sums, 1, z["b"])) + total(F.slice(lengths, z["b"] * 64 + 1, i)))))


_EMPTY = ("array<struct<start:int,end:int,match:string,before:string,after:string>>")


def _found(df: DataFrame, text: Column, pattern: str, gate: Column, out: str) -> DataFrame:
    """Add the matches of a pattern, with places in code points and the text around them."""
    cut, hit, a, b = (free_name(df, f"_{out}_{x}") for x in ("cut", "hit", "a", "b"))
    df = df.withColumn(hit, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.size(hit) > 0
    df = df.withColumn(cut, F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn(a, F.when(some, F.transform(cut, lambda x: F.char_length(x))))
    df = df.withColumn(b, F.when(some, F.transform(hit, lambda x: F.char_length(x))))
    df = df.withColumn(a, F.when(some, _running(F.col(a)))).withColumn(b, F.when(some, _running(F.col(b))))
    beside = lambda i: F.coalesce(F.get(hit, i), F.lit(""))
    def one(i):
        start = F.get(a, i) + F.coalesce(F.get(b, i - 1), F.lit(0))
        return F.struct(start.alias("start"), (F.get(a, i) + F.get(b, i)).alias("end"), F.get(hit, i).alias("match"),
                        F.right(F.concat(beside(i - 1), F.get(cut, i)), F.lit(BEFORE)).alias("before"),
                        F.left(F.concat(F.get(cut, i + 1), beside(i + 1)), F.lit(AFTER)).alias("after"))
    df = df.withColumn(out, F.coalesce(F.when(some, F.transform(F.sequence(F.lit(0), F.size(hit) - 1), one)),
                                       F.array().cast(_EMPTY)))
    return df.drop(cut, hit, a, b)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0),
                                                 add) % 10 == 0)


def _passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    count = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _count(match: Column, pattern: str) -> Column:
    return F.length(match) - F.length(F.regexp_replace(match, pattern, ""))


def _features(kind: Column, c: Column) -> Column:
    """The numbers that the trees see, in the order of ``FEATURES``."""
    match, before, after = c["match"], c["before"], c["after"]
    digits = _digits(match)
    near = [F.lower(before).rlike(p) for p in _KEYWORDS.values()]
    values = [
        kind, F.length(digits), F.length(match),
        F.length(F.trim(F.regexp_replace(F.regexp_replace(match, "[^0-9]+", " "), "[0-9]+", "x").cast("string"))),
        _count(match, r"\."), _count(match, "-"), _count(match, " "), _count(match, r"[()\[\]]"),
        F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False), match.rlike(OCTETS),
        match.rlike(r"@|[\[(]at[\])]"), before.rlike("[A-Za-z0-9]$"), after.rlike("^[A-Za-z0-9]"), *near,
        _count(before, "[0-9]")]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def _proposed_kinds(match: Column) -> Column:
    """Every kind that the form of a looser match allows, as places in ``KINDS`` from 1."""
    count, dotted = F.length(_digits(match)), match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    spelt = match.rlike(r"[\[(]at[\])]")
    number = ~spelt & ~dotted
    return F.array_compact(F.array(
        F.when(spelt, 1), F.when(dotted, 2), F.when(number & count.between(12, 19), 3),
        F.when(number & count.between(LEAST_DIGITS, 15), 4)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, base, proposed`` for every row: all matches, each with kind, place, text, features and, for base, check.

    ``whole`` adds the row itself as the struct ``row``.
    """
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    df = docs.select(*row, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    number = text.rlike("[0-9]")
    gates = {"email": text.contains("@"), "ip": number, "card": number, "phone": number & text.contains("+")}
    for kind in KINDS:
        df = _found(df, text, BASE[kind], gates[kind], kind)
    df = _found(df, text, NUMBERS, number, "numbers")
    df = _found(df, text, SPELT, text.rlike(r"[\[(]at[\])]"), "spelt")

    def checked(no: int, kind: str) -> Column:
        return F.transform(kind, lambda c: F.struct(
            F.lit(no).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            _passes(kind, c["match"]).alias("passes"), _features(F.lit(no), c).alias("features")))

    base = F.concat(*[checked(i + 1, k) for i, k in enumerate(KINDS)])
    df = df.select(*["row"] * whole, "doc_id", base.alias("base"), F.concat("numbers", "spelt").alias("_loose"))

    def proposals(c: Column) -> Column:
        glued = F.when(c["before"].rlike("[A-Za-z0-9]$") | c["after"].rlike("^[A-Za-z0-9]"), False)
        return F.transform(_proposed_kinds(c["match"]), lambda k: F.struct(
            k.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), glued.alias("passes"), _features(k, c).alias("features")))

    # A span that a base match of its kind already covers is no proposal.
    known = lambda p: F.exists("base", lambda c: c["passes"] & (c["kind"] == p["kind"]) & (
        c["start"] <= p["start"]) & (c["end"] >= p["end"]))
    proposed = F.filter(F.flatten(F.transform("_loose", proposals)), lambda p: ~known(p))
    return df.select(*["row"] * whole, "doc_id", "base", F.when(F.size("_loose") > 0, proposed).otherwise(
        F.filter("base", lambda c: F.lit(False))).alias("proposed"))


def _tree_sql(lines: list[str], features: str) -> str:
    """One tree of the model's printed form as nested CASE expressions."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return f"{float(head.split()[1])!r}D"
    number, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", head).groups()
    low = _tree_sql(lines, features)
    lines.pop(0)
    return f"CASE WHEN {features}[{number}] <= {float(bound)!r}D THEN {low} ELSE {_tree_sql(lines, features)} END"


def margin_sql(model: GBTClassificationModel, features: str) -> str:
    """The model's margin over an array of features, as SQL; positive means class 1."""
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        parts.append(f"{float(weight)!r}D * ({_tree_sql(lines, features)})")
    return " + ".join(parts)


def training_rows(found: DataFrame) -> DataFrame:
    """``held, label``, the features and ``n``, how many labelled candidates have them; every one counts."""
    rows = found.select("doc_id", F.explode(F.concat("base", "proposed")).alias("c")).where("c.passes is not null")
    held = F.pmod(F.xxhash64("doc_id", "c.kind", "c.start"), F.lit(3)) == 0
    counted = rows.groupBy(held.alias("held"), F.col("c.passes").cast("double").alias("label"),
                           F.col("c.features").alias("features")).agg(F.count("*").cast("double").alias("n"))
    return counted.select("held", "label", "n", *[F.get("features", i).alias(n) for i, n in enumerate(FEATURES)])


def fit(found: DataFrame) -> tuple[str, float] | None:
    """Margin SQL over ``c.features`` and the threshold; None where there is nothing to learn from or to select."""
    rows = staged(training_rows(found), "pii-training")
    seen = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0), (True, 1.0)} <= seen:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=7,
                          stepSize=0.3).fit(vectors.where(~F.col("held")))
    sql = margin_sql(model, "c.features")
    alone = rows.where("held").select("label", "n", F.struct(F.array(*FEATURES).alias("features")).alias("c"))
    steps = alone.groupBy(F.round(F.expr(sql), 2).alias("margin")).agg(
        F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("ones")).orderBy(F.desc("margin")).collect()
    n = ones = 0
    threshold = None
    for step in steps:
        n, ones = n + step["n"], ones + step["ones"]
        if ones >= PRECISION * n:
            threshold = step["margin"]
    return None if threshold is None else (sql, float(threshold))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, base, added`` for every row: arrays of kind, start and end (code points, end exclusive), in order."""
    found = staged(candidates(docs, id_col, text_col, whole), "pii-candidates")
    fitted = fit(found)
    order = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))  # noqa: E731,E501
    base = order(F.filter("base", lambda c: c["passes"]))
    if fitted is None:
        added = F.filter(base, lambda c: F.lit(False))
    else:
        sql, threshold = fitted
        added = order(F.expr(f"filter(proposed, c -> c.passes is null and round({sql}, 2) >= {threshold!r}D)"))
    return found.select(*["row"] * whole, "doc_id", base.alias("base"), F.array_distinct(added).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "redacted") -> DataFrame:
    """All rows and columns, and the text with ``[email]``, ``[ip]``, ``[card]`` or ``[phone]`` in place of each span.

    Spans that overlap become one, named by the first of them.  A null text stays null.
    """
    spans = F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"),
                                                                      c["kind"].alias("kind")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def join(held, c):
        last = F.element_at(held, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"), last["kind"].alias("kind"))
        apart = F.concat(held, F.array(c))
        return F.when(F.size(held) == 0, apart).when(c["start"] < last["end"], F.concat(
            F.slice(held, F.lit(1), F.size(held) - 1), F.array(longer))).otherwise(apart)

    merged = F.aggregate(F.array_sort(spans), empty, join)
    text, names = F.col("row")[text_col].cast("string"), F.array(*[F.lit(k) for k in KINDS])
    before = lambda m, i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])
    parts = F.transform("_merged", lambda c, i: F.concat(
        F.substring(text, before(F.col("_merged"), i) + 1, c["start"] - before(F.col("_merged"), i)),
        F.lit("["), F.element_at(names, c["kind"]), F.lit("]")))
    tail = F.substring(text, F.element_at("_merged", -1)["end"] + 1, F.lit(1 << 30))
    found = find_spans(docs, id_col, text_col, whole=True).withColumn("_merged", merged)
    return found.select("row.*", F.when(F.size("_merged") == 0, text).otherwise(
        F.concat(F.array_join(parts, ""), tail)).alias(free_name(docs, out)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")
