"""Quality rules by weak supervision: rules vote or abstain, and a posterior probability decides.

Each rule is a SQL expression over counts of a text and votes good (1), bad (-1) or abstains (0).  Rows are counted by
their pattern of votes, at most ``3 ** len(RULES)`` patterns whatever the input.  Expectation-maximisation over
those counts, so over all rows, estimates the accuracy of each rule; the posterior of each pattern is the probability
that its texts are good.  Two hard limits on length and repetition hold besides.

Words are runs of everything but ASCII blanks.  Null and empty texts have no words, fail the length limit and are not
kept.  Rows are independent but for the estimates: repeated rows count again, null ids and other columns pass through.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.llm.frames import staged, with_python

#: Hard limits: fewest words, and the share in percent of words inside repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Least posterior probability of a kept text.
KEEP_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_stops", "n_bangs", "n_distinct"]

_CONTINUATION, _BLANK = bytes(range(0x80, 0xC0)), b" \t\n\x0b\x0c\r"
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))


def repeated_words(codes: np.ndarray, size: int) -> int:
    """Words inside three-word windows that occur at least twice; ``codes`` are below ``size``."""
    if len(codes) < 4:
        return 0
    windows = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[place] > 1)
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[twice + k] = True
    return int(inside.sum())


class Counter:
    """The counts of texts; numbers words within a bound, so that windows of three fit 63 bits."""

    def __init__(self, most: int = 400_000):
        self._most, self._places = most, {}

    def _codes(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        distinct = set(words)
        if len(self._places) + len(distinct) > self._most:
            self._places = {}
        places = self._places
        new = list(distinct.difference(places))
        places.update(zip(new, range(len(places), len(places) + len(new))))
        codes = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        if len(places) >= 1 << 20:
            codes = np.unique(codes, return_inverse=True)[1]
        return codes, min(len(places), int(codes.max(initial=0)) + 1)

    def count(self, text: bytes) -> list[int]:
        words = text.split()
        codes, size = self._codes(words)
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        n = len(text)
        return [len(words), len(text.translate(None, _CONTINUATION + _BLANK)), n - len(text.translate(None, _SYMBOLS)),
                len(lines) - len(set(lines)), repeated_words(codes, size), len(lines),
                n - len(text.translate(None, _UPPER)), len(text.translate(None, _NOT_LETTERS)),
                n - len(text.translate(None, b".!?;:")), text.count(b"!"), len(set(words))]


def with_counts(docs: DataFrame, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """All rows and columns with the counts of ``COUNTS`` appended, under ``names`` if given."""
    fields = [T.StructField(n, T.LongType(), False) for n in names or COUNTS]

    def make():
        counter = Counter()

        def compute(texts: list[bytes]) -> list[np.ndarray]:
            return list(np.array([counter.count(t) for t in texts], np.int64).reshape(-1, len(COUNTS)).T)

        return compute

    return with_python(docs, text_col, fields, make)


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts: a text for which ``bad`` holds gets the vote bad, else ``good`` the vote good.

    Otherwise, and where a condition is null, the rule abstains.
    """

    name: str
    bad: str = "false"
    good: str = "false"


RULES = [
    Rule("symbols", bad="n_symbols >= 0.15 * n_words"),
    Rule("repeats", bad="n_repeat_words >= 0.4 * n_words"),
    Rule("copied lines", bad="n_dup_lines >= 0.5 * n_lines"),
    Rule("capitals", bad="n_upper >= 0.4 * n_letters"),
    Rule("letters", bad="n_letters < 0.7 * word_chars"),
    Rule("exclamations", bad="n_bangs >= 0.2 * n_words"),
    Rule("variety", bad="n_distinct < 2 * sqrt(n_words)"),
    Rule("sentences", bad="n_stops < 0.005 * n_words", good="n_stops between 0.03 * n_words and 0.3 * n_words and "
         "n_symbols < 0.05 * n_words and n_upper < 0.2 * n_letters"),
    Rule("prose", good="n_letters >= 0.85 * word_chars and n_repeat_words < 0.2 * n_words and n_bangs < 0.05 * n_words "
         "and n_symbols < 0.05 * n_words and n_dup_lines < 0.3 * n_lines"),
]


def pattern(rules: list[Rule] = RULES, prefix: str = "") -> Column:
    """The votes on a row as one number, a digit from 0 (bad) to 2 (good) to each rule, abstaining is 1.

    ``prefix`` stands before the count columns.
    """
    def sql(text: str) -> Column:
        return F.expr(re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"`{prefix}\1`", text))

    total = F.lit(0)
    for k, rule in enumerate(rules):
        total = total + F.when(sql(rule.bad), 0).when(sql(rule.good), 2).otherwise(1) * 3 ** k
    return total.cast("int")


def posteriors(counts: dict[int, int], n_rules: int, rounds: int = 500, tolerance: float = 1e-9) -> dict[int, float]:
    """Probability of good for each pattern of votes, from the number of rows with each pattern.

    Each rule is right in a share of its votes, its accuracy, whatever the text; abstaining says nothing, and a text
    without votes is as likely good as bad.  Ten imagined votes, eight of them right, keep accuracies of rules that
    hardly ever vote above chance.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[c] for c in codes.tolist()], np.float64)
    votes = codes[:, None] // 3 ** np.arange(n_rules)[None, :] % 3 - 1
    cast, accuracy = np.abs(votes), np.full(n_rules, 0.8)
    good = np.zeros(len(codes))
    for _ in range(rounds):
        odds = votes @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done, good = np.abs(new - good).max() < tolerance, new
        if done:
            break
        right = np.where(votes > 0, good[:, None], 1 - good[:, None]) * cast
        accuracy = np.clip(((weight[:, None] * right).sum(0) + 8) / ((weight[:, None] * cast).sum(0) + 10), 0.51, 0.999)
    return dict(zip(codes.tolist(), good.tolist()))


def verdict_table(counted: DataFrame, code: Column, n_rules: int) -> DataFrame:
    """``code, p_good`` for each pattern that occurs; at most ``3 ** n_rules`` rows."""
    rows = counted.groupBy(code.alias("code")).count().collect()
    found = posteriors({r["code"]: r["count"] for r in rows}, n_rules)
    return counted.sparkSession.createDataFrame(list(found.items()), "code int, p_good double")


def hard_failure(prefix: str = "") -> Column:
    words, repeats = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``p_good`` and ``kept`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = staged(with_counts(rows).select("doc_id", *COUNTS).withColumn("code", pattern()), "quality-counts")
    verdicts = verdict_table(counted, F.col("code"), len(RULES))
    return (counted.join(F.broadcast(verdicts), "code").withColumn("base_failed", hard_failure())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))
            .select("doc_id", *COUNTS, "base_failed", "p_good", "kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns.  Counts are made twice rather than carrying texts to a join."""
    prefix = "_count_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = [prefix + c for c in COUNTS]
    thin = with_counts(docs.select(text_col), text_col, names)
    verdicts = verdict_table(thin, pattern(prefix=prefix), len(RULES)).withColumnRenamed("code", prefix + "code")
    good = F.broadcast(verdicts.where(F.col("p_good") >= KEEP_FROM).select(prefix + "code"))
    counted = with_counts(docs, text_col, names).withColumn(prefix + "code", pattern(prefix=prefix))
    return counted.where(~hard_failure(prefix)).join(good, prefix + "code", "left_semi").select(*docs.columns)
