"""Attempt logs, model responses, training pairs and character counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.functions.text import tally

MAX_RETRIES = 5
ENVELOPE_KEYS = ("python_code", "pytest_code")


def check_envelope(df: DataFrame, column: str = "response", keys: tuple[str, ...] = ENVELOPE_KEYS) -> DataFrame:
    """Add ``verdict``: ``ok``, ``invalid_json`` or ``missing:<first key not there>``.

    Anything that is valid JSON but no object has no keys, so it misses the first one.
    """
    raw = F.col(column)
    present = F.json_object_keys(raw)
    outcome = F.when(raw.isNull() | F.try_parse_json(raw).isNull(), "invalid_json")
    for key in keys:
        outcome = outcome.when(present.isNull() | ~F.array_contains(present, key), f"missing:{key}")
    return df.withColumn("verdict", outcome.otherwise("ok"))


def attempt_rollup(log: DataFrame, run: str = "run_id", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Per run: attempts used, last stage and status, convergence, failures by stage."""
    last = F.max_by(F.struct("stage", "status"), F.struct("attempt", "seq"))
    failed = lambda stage: F.count_if((F.col("status") == "error") & (F.col("stage") == stage))
    won = (F.col("stage") == "success") & (F.col("status") == "success") & (F.col("attempt") <= max_retries)
    rolled = log.groupBy(run).agg(
        F.max("attempt").alias("attempts"), last.alias("_last"), F.bool_or(won).alias("converged"),
        failed("llm_call").alias("llm_failures"), failed("pytest").alias("pytest_failures"),
        failed("equivalence").alias("equivalence_failures"))
    return rolled.select(run, "attempts", F.col("_last.stage").alias("final_stage"),
                         F.col("_last.status").alias("final_status"), "converged",
                         "llm_failures", "pytest_failures", "equivalence_failures")


def last_feedback(log: DataFrame, run: str = "run_id", fed_back: int = 2000, logged: int = 800) -> DataFrame:
    """Tail of each run's last error, as fed back and as logged."""
    last = (log.where(F.col("status") == "error").groupBy(run)
            .agg(F.max_by(F.struct("attempt", "stage", "message"), F.struct("attempt", "seq")).alias("m")))
    return last.select(run, F.col("m.attempt").alias("attempt"), F.col("m.stage").alias("stage"),
                       F.right("m.message", F.lit(fed_back)).alias("feedback"),
                       F.right("m.message", F.lit(logged)).alias("log_message"))


def inspect_tally(df: DataFrame, column: str, pieces: dict[str, str]) -> DataFrame:
    """Total occurrences of each piece over a column, one output column per name."""
    return df.agg(*[F.coalesce(F.sum(tally(F.col(column), piece)), F.lit(0).cast("bigint")).alias(name)
                    for name, piece in pieces.items()])


# Numbers with a decimal point, and the wrapper that makes one exact.
BARE_FLOAT = r"\b\d+\.\d+\b"


def bare_float(output: Column) -> Column:
    """A decimal literal outside ``Decimal('...')``, unless its value is whole."""

    def bare(number: Column) -> Column:
        wrapped = (F.contains(output, F.concat(F.lit("Decimal('"), number, F.lit("')")))
                   | F.contains(output, F.concat(F.lit('Decimal("'), number, F.lit('")'))))
        whole = F.regexp_extract(number, r"\.(\d+)", 1).rlike("^0+$")
        return ~wrapped & ~whole

    return F.exists(F.regexp_extract_all(output, F.lit(BARE_FLOAT), F.lit(0)), bare)


def audit_pairs(pairs: DataFrame, minimum: int, marker: str | None = None, categories: list[str] = (),
                needed_when: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Quality gate over ``(input, output)`` pairs: one row per rule with violations and a pass flag.

    ``marker`` must be in at least half of the outputs; every category must be in some input;
    ``needed_when`` maps a rule name to (text in the input, text the output must then hold).
    """
    i, o = F.col("input"), F.col("output")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    counts = {
        "pairs": F.count(F.lit(1)),
        "missing_key": F.count_if(i.isNull() | o.isNull()),
        "empty_field": F.count_if((i.isNotNull() & blank(i)) | (o.isNotNull() & blank(o))),
        "bare_float": F.count_if(F.coalesce(bare_float(o), F.lit(False))),
        "_marked": F.count_if(F.contains(o, F.lit(marker))) if marker else F.lit(0),
    }
    for n, category in enumerate(categories):
        counts[f"_category{n}"] = F.count_if(F.contains(i, F.lit(category)))
    for name, (when, then) in (needed_when or {}).items():
        counts[name] = F.count_if(F.contains(i, F.lit(when)) & ~F.coalesce(F.contains(o, F.lit(then)), F.lit(False)))
    one = pairs.agg(*[c.cast("bigint").alias(n) for n, c in counts.items()])
    rule = lambda name, value, passed: F.struct(F.lit(name).alias("rule"), value.cast("bigint").alias("value"),
                                                passed.alias("passed"))
    rules = [rule("minimum_pairs", F.col("pairs"), F.col("pairs") >= minimum)]
    rules += [rule(n, F.col(n), F.col(n) == 0) for n in ("missing_key", "empty_field", "bare_float")]
    if marker:
        rules.append(rule("marker_ratio", F.col("_marked"), F.col("_marked") >= F.floor(F.col("pairs") / 2)))
    rules += [rule(f"covers:{c}", F.col(f"_category{n}"), F.col(f"_category{n}") > 0) for n, c in enumerate(categories)]
    rules += [rule(n, F.col(n), F.col(n) == 0) for n in (needed_when or {})]
    return one.select(F.inline(F.array(*rules)))
