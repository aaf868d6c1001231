"""Queries over attempt logs, model responses, training pairs and character counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.operators import audit as A
from zonedeck.operators import retrieve as R
from zonedeck.operators import training as T
from zonedeck.plans import carriers as C
from zonedeck.plans.registry import query
from zonedeck.session import spread


@query("check_envelope", """
    SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'missing:python_code'
        WHEN 2 THEN 'missing:pytest_code' WHEN 3 THEN 'missing:python_code' ELSE 'ok' END AS verdict FROM conversations""")
def check_envelope(spark, sf_dir):
    """Every turn becomes a response; some are broken, wrapped in an array or short of a key."""
    turns = C.table(spark, sf_dir, "conversations")
    text, role = F.col("text"), F.col("role")
    whole = F.to_json(F.struct(text.alias("python_code"), role.alias("pytest_code"), F.col("turn").alias("extra")))
    shape = (F.col("conv_id") * 3 + F.col("turn")) % 7
    response = (F.when(shape == 0, F.left(whole, F.length(whole) - 1))
                .when(shape == 1, F.concat(F.lit("["), whole, F.lit("]")))
                .when(shape == 2, F.to_json(F.struct(text.alias("python_code"))))
                .when(shape == 3, F.to_json(F.struct(role.alias("pytest_code"))))
                .otherwise(whole))
    return A.check_envelope(turns.select("conv_id", "turn", response.alias("response"))).drop("response")


_LOG = C.ATTEMPTS.sql


@query("attempt_rollup", f"""
    SELECT run_id, max(attempt) AS attempts, arg_max(stage, (attempt, seq)) AS final_stage, arg_max(status, (attempt, seq)) AS final_status,
           bool_or(stage = 'success' AND status = 'success' AND attempt <= 5) AS converged,
           count(*) FILTER (status = 'error' AND stage = 'llm_call') AS llm_failures,
           count(*) FILTER (status = 'error' AND stage = 'pytest') AS pytest_failures,
           count(*) FILTER (status = 'error' AND stage = 'equivalence') AS equivalence_failures
    FROM {_LOG} GROUP BY run_id""")
def attempt_rollup(spark, sf_dir):
    return A.attempt_rollup(C.ATTEMPTS.df(spark, sf_dir))


@query("last_feedback", f"""
    SELECT run_id, arg_max(attempt, (attempt, seq)) AS attempt, arg_max(stage, (attempt, seq)) AS stage,
           right(arg_max(message, (attempt, seq)), 2000) AS feedback, right(arg_max(message, (attempt, seq)), 800) AS log_message
    FROM {_LOG} WHERE status = 'error' GROUP BY run_id""")
def last_feedback(spark, sf_dir):
    return A.last_feedback(C.ATTEMPTS.df(spark, sf_dir))


@query("last_feedback_long", """
    SELECT conv_id AS run_id, right(arg_max(text, turn), 2000) AS feedback, right(arg_max(text, turn), 800) AS log_message
    FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def last_feedback_long(spark, sf_dir):
    """Long messages: the assistant's turns as errors, where the tails really cut."""
    log = C.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("attempt"), F.col("turn").alias("seq"), F.lit("pytest").alias("stage"),
        F.when(F.col("role") == "assistant", "error").otherwise("info").alias("status"), F.col("text").alias("message"))
    return A.last_feedback(log).select("run_id", "feedback", "log_message")


@query("inspect_tally", """
    SELECT CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS letter_e,
           CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS word_the,
           CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS line_ends FROM documents""")
def inspect_tally(spark, sf_dir):
    docs = spread(C.table(spark, sf_dir, "documents").select("text"))
    return A.inspect_tally(docs, "text", {"letter_e": "e", "word_the": "the", "line_ends": "\n"})


_PAIRS = """
    (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u
     JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def pairs(spark, sf_dir):
    return T.pair_turns(C.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("audit_pairs", f"""
    WITH c AS (SELECT count(*) AS n,
        count(*) FILTER (trim(input) = '' OR trim(output) = '') AS empty,
        count(*) FILTER (len(list_filter(regexp_extract_all(output, '\\b\\d+\\.\\d+\\b'), lambda x:
            NOT contains(output, 'Decimal(''' || x || ''')') AND NOT regexp_matches(x, '\\.0+$'))) > 0) AS bare,
        count(*) FILTER (contains(output, 'e')) AS marked, count(*) FILTER (contains(input, 'the')) AS cat1,
        count(*) FILTER (contains(input, 'EXEC CICS')) AS cat2,
        count(*) FILTER (contains(input, '?') AND NOT contains(output, '.')) AS unanswered FROM {_PAIRS})
    SELECT 'minimum_pairs' AS rule, n AS value, n >= 20 AS passed FROM c
    UNION ALL SELECT 'missing_key', 0, true FROM c UNION ALL SELECT 'empty_field', empty, empty = 0 FROM c
    UNION ALL SELECT 'bare_float', bare, bare = 0 FROM c UNION ALL SELECT 'marker_ratio', marked, marked >= n // 2 FROM c
    UNION ALL SELECT 'covers:the', cat1, cat1 > 0 FROM c UNION ALL SELECT 'covers:EXEC CICS', cat2, cat2 > 0 FROM c
    UNION ALL SELECT 'unanswered', unanswered, unanswered = 0 FROM c""")
def audit_pairs(spark, sf_dir):
    return A.audit_pairs(pairs(spark, sf_dir), minimum=20, marker="e", categories=["the", "EXEC CICS"],
                         needed_when={"unanswered": ("?", ".")})


SYSTEM_TEXT = "You translate commands."
_PROMPT = f"""concat('<|system|>', chr(10), '{SYSTEM_TEXT}', chr(10), '<|user|>', chr(10), input, chr(10), '<|assistant|>', chr(10))"""


_ASKED = f"""
    (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output, coalesce((
         SELECT arg_max(s.text, s.turn) FROM conversations s WHERE s.conv_id = u.conv_id AND s.role = 'system' AND s.turn < u.turn),
         '{SYSTEM_TEXT}') AS system
     FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
     WHERE u.role = 'user')"""
_TURN_PROMPT = _PROMPT.replace(f"'{SYSTEM_TEXT}'", "system")


@query("render_chat", f"""
    SELECT conv_id, turn, md5({_TURN_PROMPT}) AS prompt,
           CASE WHEN output IS NOT NULL THEN md5(concat({_TURN_PROMPT}, output, '{T.END_MARK}')) END AS full_text FROM {_ASKED}""")
def render_chat(spark, sf_dir):
    """Every user turn under its conversation's own system text; turns without an answer are prompts only."""
    turns, names = C.table(spark, sf_dir, "conversations"), ("conv_id", "turn", "role", "text")
    asked = T.with_system(T.pair_turns(turns, *names, answered=False), turns, *names, SYSTEM_TEXT)
    rendered = T.render_chat(asked, F.col("system"))
    return rendered.select("conv_id", "turn", F.md5("prompt").alias("prompt"), F.md5("full_text").alias("full_text"))


@query("count_turns", """
    SELECT count(*) FILTER (t.role = 'user') AS asked, count(*) FILTER (t.role = 'assistant' AND b.role = 'user') AS answered,
           count(*) FILTER (t.role = 'assistant' AND coalesce(b.role, '') <> 'user') AS unasked,
           count(*) FILTER (t.role = 'system') AS system_turns,
           count(*) FILTER (t.role = 'user') - count(*) FILTER (t.role = 'assistant' AND b.role = 'user') AS unanswered
    FROM conversations t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1""")
def count_turns(spark, sf_dir):
    return T.count_turns(C.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("render_request_retry", f"""
    SELECT r.run_id, md5(concat('COBOL source to translate:', chr(10), chr(10), '```cobol', chr(10), r.text, chr(10), '```',
           CASE WHEN f.feedback IS NOT NULL THEN concat(chr(10), chr(10), 'Feedback from previous attempt (fix this):', chr(10), f.feedback)
                ELSE '' END)) AS request
    FROM (SELECT run_id, concat('PROGRAM ', run_id, ' ', max(attempt)) AS text FROM {_LOG} GROUP BY run_id) r
    LEFT JOIN (SELECT run_id, right(arg_max(message, (attempt, seq)), 2000) AS feedback FROM {_LOG} WHERE status = 'error' GROUP BY run_id) f
           ON f.run_id = r.run_id""")
def render_request_retry(spark, sf_dir):
    """The next request of each run: with the last error as feedback, or as a first request where there was none."""
    log = C.ATTEMPTS.df(spark, sf_dir)
    runs = log.groupBy("run_id").agg(F.concat(F.lit("PROGRAM "), "run_id", F.lit(" "), F.max("attempt").cast("string")).alias("text"))
    last = A.last_feedback(log).select("run_id", "feedback")
    asked = runs.join(last, "run_id", "left").withColumn("feedback", F.coalesce("feedback", F.lit(R.FIRST_REQUEST)))
    return R.render_request(asked, feedback="feedback").select("run_id", F.md5("user_prompt").alias("request"))


def _spans_sql(masked):
    count = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))".format
    return f"""
    SELECT conv_id, turn, CAST(p AS INTEGER) AS prompt_tokens, CAST(t AS INTEGER) AS total_tokens, CAST(least(t, 1024) AS INTEGER) AS kept_tokens,
           CAST({masked} AS INTEGER) AS mask_end, CAST(least(t, 1024) - {masked} AS INTEGER) AS loss_tokens,
           least(p, 512, t) < least(p, t, 1024) AS prompt_leaks
    FROM (SELECT conv_id, turn, {count(_PROMPT)} AS p, {count(f"concat({_PROMPT}, output, '{T.END_MARK}')")} AS t FROM {_PAIRS})"""


def spans(spark, sf_dir, **options):
    rendered = T.render_chat(pairs(spark, sf_dir), SYSTEM_TEXT)
    return T.loss_spans(rendered, **options).drop("input", "output", "prompt", "full_text")


@query("loss_spans", _spans_sql("least(p, t, 1024)"))
def loss_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query("loss_spans_reference_mask", _spans_sql("least(p, 512, t, 1024)"))
def loss_spans_reference_mask(spark, sf_dir):
    return spans(spark, sf_dir, reference_mask=True)
