"""Analysis of a corpus of source programs, one row per program.

Almost everything is a narrow projection over the program's text: no shuffle, whatever the
size of the corpus.  ``key`` names the program's identifying column.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.functions import patterns as P
from zonedeck.operators.lookup import lookup_join
from zonedeck.session import fits_broadcast

def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.COMMAND_BLOCK), F.lit(0))


def needs_record_work(text: Column) -> Column:
    """Packed numbers or a dataset hint; plain binary numbers alone do not count."""
    return text.rlike(P.PACKED_USAGE) | text.rlike(P.DATASET_HINT)


def detect_constructs(corpus: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return corpus.withColumns({"cics": t.rlike(P.COMMAND_BLOCK), "vsam": needs_record_work(t)})


_SIMPLE = r"\(\?iU?\)((?:\\b|[A-Za-z0-9 |().-])+)"
_ASCII_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
#: ASCII characters that are no part of a word.
_BETWEEN = "".join(chr(c) for c in range(128) if chr(c).upper() not in _ASCII_WORD)


def _alternatives(pattern: str) -> list[str] | None:
    """The alternatives of a pattern of upper- or lower-case words; NULL where it is not that simple.

    A group is only known as the whole pattern between word borders.
    """
    body = re.fullmatch(_SIMPLE, pattern)
    if not body:
        return None
    group = re.fullmatch(r"\\b\(([^()]*)\)\\b", body[1])
    found = [rf"\b{a}\b" for a in group[1].split("|")] if group else body[1].split("|")
    return None if any("(" in a or ")" in a or not re.match(r"(\\b)?[A-Za-z0-9]", a) for a in found) else found


def _words(pattern: str) -> list[str]:
    """The upper-case words of a pattern that stand for themselves between word borders."""
    pure = [re.fullmatch(r"\\b([A-Za-z0-9]+)\\b", a) for a in _alternatives(pattern) or []]
    return [m[1].upper() for m in pure if m]


def _other_hit(text: Column, plain: Column, pattern: str, alternative: str) -> Column:
    """Whether an alternative that is not a single word occurs in a plain ASCII text, given in upper case as well."""
    open_left, literal, rest = re.fullmatch(r"(\\b)?([A-Za-z0-9 -]*)(.*)", alternative).groups()
    at = F.instr(plain, literal.upper())
    if not open_left or rest not in ("", r"\b"):
        return (at > 0) & text.rlike(pattern)
    # The characters around the first place decide, unless that place lies within a word.
    before = F.when(at > 1, F.substring(plain, at - 1, F.lit(1))).otherwise("")
    after = F.substring(plain, at + len(literal), F.lit(1)) if rest else F.lit("")
    clear = ~F.concat(before, after).rlike("[A-Z0-9_]")
    return F.when(at == 0, F.lit(False)).when(clear, F.lit(True)).otherwise(text.rlike(pattern))


def _tag_list(text: Column, plain: Column, present: Column, rules: list[tuple[str, str]], always: str | None) -> Column:
    first = [F.lit(always)] if always else []
    found = []
    for pattern, tag in rules:
        if tag == always:
            continue
        alternatives, hit = _alternatives(pattern), text.rlike(pattern)
        if alternatives:
            words = _words(pattern)
            others = [a for a in alternatives if not re.fullmatch(r"\\b[A-Za-z0-9]+\\b", a)]
            tests = [F.arrays_overlap(present, F.array(*map(F.lit, words)))] if words else []
            fast = reduce(lambda a, b: a | b, [*tests, *[_other_hit(text, plain, pattern, a) for a in others]])
            hit = F.when(plain.isNull(), hit).otherwise(fast)
        found.append(F.when(hit, F.lit(tag)))
    # Drops NULLs and repeats in one generated expression; array_compact would leave code generation.
    return F.array_except(F.array(*first, *found), F.array(F.lit(None).cast("string")))


def _plain(text: Column) -> Column:
    """The text in upper case if it is ASCII, else NULL."""
    return F.when(F.length(text) == F.octet_length(text), F.upper(text))


def _ascii_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of an upper-case text, and some empty strings."""
    return F.split(F.translate(text, _BETWEEN, " " * len(_BETWEEN)), " ")


def tag_rules(docs: DataFrame, rules: list[tuple[str, str]] | DataFrame = P.KEYWORD_RULES,
              always: str | None = P.ALWAYS_TAG, text: str = "text") -> DataFrame:
    """Add ``tags``: those of all matching rules in rule order, each once, after the one always given.

    A rule list is part of the plan.  In a plain ASCII text one pass finds the words that the rules ask for, which
    settles rules made of whole words; phrases are looked for as they are; a pattern is tried only on what is left.

    A rule table ``(ord, pattern, tag)`` may have any length and stays a table, see ``_tag_by_table``.
    """
    if isinstance(rules, DataFrame):
        return _tag_by_table(docs, rules, always, text)
    t = F.col(text)
    words = sorted({w for pattern, tag in rules if tag != always for w in _words(pattern)})
    present = F.array_intersect(_ascii_words(F.col("_plain")), F.array(*map(F.lit, words)).cast("array<string>"))
    return (docs.withColumn("_plain", _plain(t)).withColumn("_present", present)
            .withColumn("tags", _tag_list(t, F.col("_plain"), F.col("_present"), rules, always)).drop("_plain", "_present"))


#: Rules of a table that are no whole words and are tried on a text together.
CHUNK_RULES = 500
# Characters beyond ASCII that stand for an ASCII letter where case is ignored.
_FOLDED, _FOLDED_TO = "\u0130\u0131\u017f\u212a", "IISK"


def _tag_by_table(docs: DataFrame, rules: DataFrame, always: str | None, text: str) -> DataFrame:
    """Rules that are alternatives of whole words are joined to the distinct words of each text, so a text only meets
    rules whose words it has; the matches of a text that is not ASCII are tried once more as patterns.  All other rules
    are tried on every text, ``CHUNK_RULES`` at a time, as arrays that subqueries read from the table.

    Matches are found for each distinct text and joined back by its hash.
    """
    body = F.regexp_extract("pattern", r"^\(\?iU\)\\b\(?([A-Za-z0-9|\\b]+?)\)?\\b$", 1)
    plain_words = F.col("pattern").rlike(r"^\(\?iU\)\\b(?:\([A-Za-z0-9]+(?:\|[A-Za-z0-9]+)*\)|[A-Za-z0-9]+(?:\\b\|\\b[A-Za-z0-9]+)*)\\b$")
    rule = F.struct("ord", "tag", "pattern").alias("rule")
    keys = rules.where(plain_words).select(rule, F.explode(F.split(F.upper(F.regexp_replace(body, r"\\b", "")), r"\|")).alias("_word"))
    others = rules.where(~F.coalesce(plain_words, F.lit(False)) & F.col("pattern").isNotNull()).select(rule)
    t = F.col(text)
    keyed = docs.withColumn("_key", F.when(t.isNotNull(), F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"), F.length(t).alias("n"))))
    # A word of the text between borders is also one between ASCII characters that are no part of words.
    folded = F.regexp_replace(F.upper(F.translate(t, _FOLDED, _FOLDED_TO)), r"[^\x00-\x7f]", " ")
    own = F.when(F.length(t) == F.octet_length(t), F.upper(t)).otherwise(folded)
    words = keyed.select("_key", F.explode(F.array_distinct(_ascii_words(own))).alias("_word")).where("_word <> ''")
    met = words.join(F.broadcast(keys) if fits_broadcast(keys) else keys, "_word")
    # Copies of a text are reduced to one before they meet.
    hits = met.groupBy("_key", "rule").agg(F.count("*")).groupBy("_key").agg(F.collect_list("rule").alias("_rules"))
    met = keyed.join(hits, "_key", "left")
    true = lambda found: F.filter(found, lambda r: F.rlike(t, r["pattern"]))
    found = F.when(F.length(t) == F.octet_length(t), F.col("_rules")).otherwise(true(F.col("_rules")))
    found = [F.coalesce(found, F.array().cast(hits.schema["_rules"].dataType))]
    chunks = -(-others.count() // CHUNK_RULES)
    for i in range(chunks):
        chunk = others.where(F.pmod(F.xxhash64("rule"), F.lit(chunks)) == i).agg(F.collect_list("rule").alias("r"))
        met = met.withColumn(f"_chunk{i}", chunk.scalar())
        found.append(F.coalesce(true(F.col(f"_chunk{i}")), F.array().cast(hits.schema["_rules"].dataType)))
    ordered = F.transform(F.array_sort(F.concat(*found)), lambda r: r["tag"])
    first = F.array(F.lit(always)) if always else F.array().cast("array<string>")
    return met.withColumn("tags", F.array_distinct(F.concat(first, ordered))).drop("_key", "_rules", *[f"_chunk{i}" for i in range(chunks)])


def _unfold(df: DataFrame, key: str, found: Column) -> DataFrame:
    """``(key, pos, original)``, positions from 1.

    The plain form of the generator makes Spark test beforehand that the list is not empty, which
    here would mean finding everything twice.
    """
    return (df.select(key, F.posexplode_outer(found).alias("_at", "original")).where(F.col("_at").isNotNull())
            .select(key, (F.col("_at") + 1).alias("pos"), "original"))


def extract_blocks(corpus: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, pos, original)`` for every command block."""
    return _unfold(corpus, key, _blocks(F.col(text)))


def _records(text: Column, strict: bool) -> Column:
    """Level-01 records with packed or binary numbers."""
    found = F.regexp_extract_all(text, F.lit(P.RECORD), F.lit(0))
    if strict:
        found = F.transform(found, lambda r: F.regexp_replace(
            r, r"(?dims)^[ \t]*[\w-]+[ \t]+(?:DIVISION|SECTION)\b.*", ""))
    return F.filter(found, lambda r: r.rlike(P.PACKED_USAGE) | r.rlike(P.BINARY_USAGE))


def extract_records(corpus: DataFrame, key: str = "path", text: str = "text", strict: bool = False) -> DataFrame:
    """``(key, pos, original)`` for every such record of programs that need record work.

    Without ``strict`` the last record of a program runs to the end of its text;
    with it a record ends at the next division or section header.
    """
    return _unfold(corpus, key, F.when(needs_record_work(F.col(text)), _records(F.col(text), strict)))


def stub(original: Column, translated: Column) -> Column:
    """What stands in for a translated block."""
    first_line = F.trim(F.regexp_extract(original, r"^[^\r\n]*", 0))
    return F.concat(F.lit(f"{P.STUB_OPEN}\n# Original: "), first_line, F.lit("...\n"), translated,
                    F.lit(f"\n{P.STUB_CLOSE}"))


def substitute_blocks(corpus: DataFrame, translations: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Replace blocks by stubs; ``translations (original, translated)`` has one row per distinct block.

    Replacement goes by position, so a block that occurs twice, or that also occurs inside a stub,
    is still replaced exactly where it stood.  A block nobody translated stays as it is.
    """
    blocks = lookup_join(extract_blocks(corpus, key, text), translations, ["original"])
    put = F.coalesce(stub(F.col("original"), F.col("translated")), F.col("original"))
    stubs = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", put.alias("put")))).alias("_stubs"))
    pieces = F.split(F.col(text), P.COMMAND_BLOCK, -1)
    woven = F.zip_with(pieces, F.col("_stubs"), lambda p, s: F.concat(p, F.coalesce(s["put"], F.lit(""))))
    enriched = F.when(F.col("_stubs").isNull(), F.col(text)).otherwise(F.array_join(woven, ""))
    return corpus.join(stubs, key, "left").withColumn("enriched", enriched).drop("_stubs")


_VERB = r"(?i)EXEC\s+CICS\s+(\w+(?:\s+(?:TS|TD|MAP|ROLLBACK)\b)?)"
_OPERAND = r"(?i)\b(?:FILE|QUEUE|PROGRAM)\s*\(\s*'?([^')]*)'?\s*\)"
_OPTION = r"(?i)\b([A-Z0-9]+)\s*\("


def describe_commands(blocks: DataFrame) -> DataFrame:
    """Command, category, operand and option names of each block."""
    original = F.col("original")
    by_command = {c: category for category, commands in P.COMMANDS.items() for c in commands}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(by_command.items())])
    command = F.upper(F.regexp_replace(F.regexp_extract(original, _VERB, 1), r"\s+", " "))
    return blocks.withColumns({
        "command": command,
        "operand": F.trim(F.regexp_extract(original, _OPERAND, 1)),
        "options": F.regexp_extract_all(original, F.lit(_OPTION), F.lit(1)),
    }).withColumn("category", F.coalesce(F.try_element_at(lookup, F.col("command")), F.lit("Other")))


def census_commands(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Counts by ``by`` and command, with the number of options used."""
    return (describe_commands(blocks).groupBy(*by, "category", "command", "operand")
            .agg(F.count(F.lit(1)).alias("uses"), F.sum(F.size("options")).alias("options")))


def segment_summary(corpus: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Segments per program, and whether it needs the shared preamble and the packed-number helpers."""
    t = F.col(text)
    blocks = F.size(_blocks(t))
    records = F.when(needs_record_work(t), F.size(_records(t, False))).otherwise(0)
    return corpus.select(key, blocks.alias("cics_segments"), records.alias("vsam_segments"),
                         (blocks + records).alias("segments"), (blocks > 0).alias("preamble"),
                         t.rlike(P.PACKED_USAGE).alias("helpers"))


# ---------------------------------------------------------------- field census

_STATEMENT = r"(?dms)^[ \t]*\d\d\s+[\w-]+.*?\.[ \t]*$"


def _symbols(picture: Column, symbols: str) -> Column:
    """How many positions the picture symbols of a class take; ``X(9)`` takes nine and holds no 9."""
    found = F.regexp_extract_all(picture, F.lit(r"[A-Z9](?:\(\d+\))?"), F.lit(0))
    fitting = F.filter(found, lambda s: s.rlike(f"^[{symbols}]"))
    size = lambda s: F.coalesce(F.regexp_extract(s, r"\((\d+)\)", 1).try_cast("int"), F.lit(1))
    return F.aggregate(fitting, F.lit(0), lambda n, s: n + size(s))


def _split_statement(statement: Column) -> Column:
    clauses = F.regexp_extract(statement, r"(?ds)^\s*\d\d\s+[\w-]+(.*)\.[ \t]*$", 1)
    return F.struct(F.left(F.trim(F.translate(statement, "\t\n\r\x0b\x0c", "     ")), F.lit(2)).cast("int").alias("level"),
                    F.regexp_extract(statement, r"^\s*\d\d\s+([\w-]+)", 1).alias("name"),
                    clauses.alias("clauses"), F.upper(clauses).alias("upper"))


def _where(head: Column, words: list[str], found: Column, otherwise: Column) -> Column:
    """``found`` for statements that have one of the words or are not ASCII, where letters may stand for others."""
    there = reduce(lambda a, b: a | b, [F.contains(head["upper"], F.lit(w)) for w in words])
    return F.when(there | (F.length(head["clauses"]) < F.octet_length(head["clauses"])), found).otherwise(otherwise)


def _parsed(head: Column) -> Column:
    clauses, empty = head["clauses"], F.lit("")
    pic = _where(head, ["PIC"], F.upper(F.regexp_extract(clauses, r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", 1)), empty)
    occurs = F.regexp_extract(clauses, r"(?i)\bOCCURS\s+(?:\d+\s+TO\s+)?(\d+)", 1).try_cast("int")
    redefines = F.regexp_extract(clauses, r"(?i)\bREDEFINES\s+([\w-]+)", 1)
    usage = (F.when(clauses.rlike(P.PACKED_USAGE), "packed").when(clauses.rlike(P.BINARY_USAGE), "binary")
             .otherwise("display"))
    separate = clauses.rlike(r"(?i)\b(LEADING|TRAILING)\s+SEPARATE").cast("int")
    return F.struct(
        head["level"].alias("level"), head["name"].alias("name"), pic.alias("pic"),
        _where(head, ["COMP", "PACKED", "BINARY"], usage, F.lit("display")).alias("usage"),
        _where(head, ["OCCURS"], F.coalesce(occurs, F.lit(1)), F.lit(1)).alias("occurs"),
        _where(head, ["REDEFINES"], redefines, empty).alias("redefines"),
        _where(head, ["SEPARATE"], separate, F.lit(0)).alias("sign_byte"),
    )


def _item_width(item: Column) -> Column:
    def coded(digits: Column) -> Column:
        return (F.when(item["usage"] == "packed", F.floor(digits / 2).cast("int") + 1)
                .when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8))

    return (F.when(item["usage"] == "group", 0)
            .when(item["usage"] == "display", _symbols(item["pic"], "9XA") + item["sign_byte"])
            .otherwise(_let(_symbols(item["pic"], "9"), coded)))


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_OPEN = "array<struct<level:int,times:int,start:int,resume:int>>"


def _place(state: Column, item: Column, names: Column) -> Column:
    """Next state after one statement.

    ``open`` has the groups that are open, ``at`` the byte position, ``first`` the number of the record's first
    statement (from 1), ``n`` the number of statements so far.  ``found`` gets 16 hex digits: where the item starts, and
    ``first``.  A fold copies its state at every step, so the fields themselves are not part of it.
    """
    top = item["level"].isin(1, 77)
    closing = F.filter(state["open"], lambda g: g["level"] >= item["level"])
    closed = F.aggregate(F.reverse(closing), state["at"], lambda p, g: F.when(g["resume"] >= 0, g["resume"])
                         .otherwise(g["start"] + (p - g["start"]) * g["times"]))
    here = F.struct(F.when(top, 0).otherwise(closed).alias("at"),
                    F.when(top, state["n"] + 1).otherwise(state["first"]).alias("first"))
    return _let(here, lambda h: _let(_start(state, item, h, names), lambda start: _placed(state, item, h, start, top)))


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 8, "0")


def _unhex(digits: Column, at: Column) -> Column:
    return F.conv(F.substring(digits, at, F.lit(8)).cast("string"), 16, 10).cast("int")


def _start(state: Column, item: Column, here: Column, names: Column) -> Column:
    """Where an item begins: at its target, the last one of that name in the record, when it is an overlay."""
    before = F.slice(names, F.greatest(here["first"], F.lit(1)), state["n"] + 1 - F.greatest(here["first"], F.lit(1)))
    back = F.array_position(F.reverse(before), item["redefines"]).cast("int")
    target = F.when(back > 0, _unhex(F.encode(state["found"], "UTF-8"), (state["n"] - back) * 16 + 1))
    return F.when(item["redefines"] == "", here["at"]).otherwise(F.coalesce(target, here["at"]))


def _placed(state: Column, item: Column, here: Column, start: Column, top: Column) -> Column:
    level, at, group, overlay = item["level"], here["at"], item["usage"] == "group", item["redefines"] != ""
    opened = F.array(F.struct(level.alias("level"), item["occurs"].alias("times"), start.alias("start"),
                              F.when(overlay, at).otherwise(-1).alias("resume"))).cast(_OPEN)
    still = F.filter(state["open"], lambda g: (g["level"] < level) & ~top)
    return F.struct(
        here["first"].alias("first"),
        F.when(group, start).when(overlay, at).otherwise(at + item["width"] * item["occurs"]).cast("int").alias("at"),
        F.when(group, F.concat(still, opened)).otherwise(still).alias("open"),
        (state["n"] + 1).alias("n"),
        F.concat(state["found"], _hex(start), _hex(here["first"])).alias("found"),
    )


def layout_census(corpus: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per data item of every record: picture, usage, byte offset and width.

    OCCURS multiplies, for groups too; an overlay starts where its target does and takes no room.
    Offsets of items inside a repeated group are those of the first repeat.  Condition names and
    renames are left out.  A program is worked through inside its own row.
    """
    statements = F.regexp_extract_all(F.col(text), F.lit(_STATEMENT), F.lit(0))
    # One stage per step: a later stage reads fields of an earlier one and never finds them again.
    heads = F.filter(F.transform(statements, _split_statement), lambda h: ~h["level"].isin(66, 88))
    # An item without a picture is a group, whatever its usage.
    items = F.transform(F.transform(heads, _parsed), lambda i: F.struct(*[
        (F.when(i["pic"] == "", "group").otherwise(i["usage"]) if n == "usage" else i[n]).alias(n)
        for n in ("level", "name", "pic", "usage", "occurs", "redefines", "sign_byte")]))
    sized = F.transform(items, lambda i: F.struct(
        *[i[n].alias(n) for n in ("level", "name", "pic", "usage", "occurs", "redefines")],
        _item_width(i).cast("int").alias("width")))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("at"), F.array().cast(_OPEN).alias("open"), F.lit(0).alias("n"),
                     F.lit("").alias("found"))
    found = F.aggregate("_items", start, lambda state, item: _place(state, item, F.col("_names")), lambda state: state["found"])
    fields = F.transform("_items", lambda i, n: F.struct(
        F.coalesce(F.get("_names", _unhex(F.col("_found"), n * 16 + 9) - 1), F.lit("")).alias("record"),
        *[i[c].alias(c) for c in ("level", "name", "pic", "usage", "occurs", "redefines")],
        _unhex(F.col("_found"), n * 16 + 1).alias("offset"),
        F.when(i["usage"] != "group", i["width"] * i["occurs"]).cast("int").alias("width")))
    return (corpus.select(key, sized.alias("_items"))
            .withColumn("_names", F.transform("_items", lambda i: i["name"]))
            .withColumn("_found", F.encode(found, "UTF-8"))
            .select(key, F.posexplode_outer(fields).alias("line", "f")).where(F.col("line").isNotNull())
            .select(key, "line", "f.*"))
