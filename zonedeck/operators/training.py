"""Training pairs as chat text, and which of its tokens count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.operators.lookup import lookup_join
from zonedeck.operators.ordering import running_total

# Chat headers, end marker and length limits.
SYSTEM, USER, ASSISTANT = "<|system|>\n", "<|user|>\n", "<|assistant|>\n"
END_MARK = "<|im_end|>"
MAX_PROMPT, MAX_TOTAL = 512, 1024


def prompt_text(system: Column, text: Column) -> Column:
    return F.concat(F.lit(SYSTEM), system, F.lit("\n" + USER), text, F.lit("\n" + ASSISTANT))


def render_chat(pairs: DataFrame, system: str | Column, end_mark: str = END_MARK) -> DataFrame:
    """Add ``prompt`` and ``full_text``; ``system`` is one text or a column.  Without an output there is no full text."""
    given = F.lit(system) if isinstance(system, str) else system
    prompted = pairs.withColumn("prompt", prompt_text(given, F.col("input")))
    return prompted.withColumn("full_text", F.concat("prompt", "output", F.lit(end_mark)))


def pair_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str, answered: bool = True) -> DataFrame:
    """Each user turn with the assistant turn that follows it.

    The two sides meet on (conversation, turn), so one endless conversation spreads like any other.  Without
    ``answered`` turns that nobody answered are kept, with a NULL output.
    """
    asked = turns.where(F.col(role) == "user").select(conversation, turn, F.col(text).alias("input"))
    answers = turns.where(F.col(role) == "assistant").select(
        conversation, (F.col(turn) - 1).alias(turn), F.col(text).alias("output"))
    return asked.join(answers, [conversation, turn], "inner" if answered else "left")


def with_system(pairs: DataFrame, turns: DataFrame, conversation: str, turn: str, role: str, text: str,
                default: str) -> DataFrame:
    """Add ``system``: the text of the last system turn before a turn of its conversation, or the default.

    The system turns of a conversation are counted through its order, and a turn meets the one of its count.  Turn
    numbers of a conversation must differ.
    """
    is_system = F.col(role) == "system"
    counted = running_total(turns.select(conversation, turn, role, text).where(F.col(conversation).isNotNull() & F.col(turn).isNotNull()),
                            [conversation], [turn], F.when(is_system, 1).otherwise(0).cast("bigint"), "_count")
    stated = counted.where(is_system).select(conversation, "_count", F.col(text).alias("_system"))
    placed = pairs.join(counted.where(~F.coalesce(is_system, F.lit(False))).select(conversation, turn, "_count"), [conversation, turn], "left")
    found = lookup_join(placed, stated, [conversation, "_count"])
    return found.withColumn("system", F.coalesce("_system", F.lit(default))).drop("_system", "_count")


def count_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row: user turns, those answered and not, answers that follow no question, and system turns."""
    next_to = turns.select(F.col(conversation).alias("_c"), (F.col(turn) + 1).alias("_t"), F.col(role).alias("_before"))
    met = turns.join(next_to, (F.col(conversation) == F.col("_c")) & (F.col(turn) == F.col("_t")), "left")
    asked, answer = F.coalesce(F.col("_before") == "user", F.lit(False)), F.col(role) == "assistant"
    counts = met.agg(F.count_if(F.col(role) == "user").alias("asked"), F.count_if(answer & asked).alias("answered"),
                     F.count_if(answer & ~asked).alias("unasked"), F.count_if(F.col(role) == "system").alias("system_turns"))
    return counts.withColumn("unanswered", F.col("asked") - F.col("answered"))


def words(text: Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def loss_spans(rendered: DataFrame, max_prompt: int = MAX_PROMPT, max_total: int = MAX_TOTAL,
               reference_mask: bool = False) -> DataFrame:
    """Kept length and the first token that counts.

    The prompt is masked whole, up to the kept length.  With ``reference_mask`` only its first
    ``max_prompt`` tokens are, which lets the rest of a long prompt count; ``prompt_leaks`` marks the
    rows where the two differ.
    """
    prompt, total = F.size(words(F.col("prompt"))), F.size(words(F.col("full_text")))
    kept = F.least(total, F.lit(max_total))
    full = F.least(prompt, kept)
    cut = F.least(prompt, F.lit(max_prompt), kept)
    masked = cut if reference_mask else full
    return rendered.withColumns({
        "prompt_tokens": prompt, "total_tokens": total, "kept_tokens": kept,
        "mask_end": masked, "loss_tokens": kept - masked, "prompt_leaks": cut < full,
    })
