"""Numeric tokens and labels of an output text, and the verdict on a pair of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number, and the tolerance.
NUMBER = r"-?\d+(?:\.\d+)?"
TOLERANCE = "0.0001"

#: Wide enough for 20 integer digits and every decimal a double can print.
TOKEN = "decimal(38,18)"


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def label_text(text: Column, strip_plus: bool = False) -> Column:
    """What is left once numbers are gone: lower case, blanks collapsed."""
    bare = F.lower(F.regexp_replace(text, ("\\+?" if strip_plus else "") + NUMBER, ""))
    # Unicode blanks count as blanks too.
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def _exact(token: Column) -> Column:
    """The token's value, NULL where it has more digits than fit."""
    point = F.instr(token, ".")
    return F.when((point == 0) | (F.length(token) - point <= 18), token.try_cast(TOKEN))


def _long_gap(e: Column, a: Column) -> Column:
    """Difference of two tokens of any length, from their aligned digits.

    Of like signs, the common start and a borrow through zeros over nines are left out and the next 37 digits are
    subtracted; differences beyond the range of ``TOKEN`` come out as its largest value, and later digits as nothing.
    """
    whole = lambda t: F.regexp_extract(t, r"^-?0*(\d*?)(?:\.\d+)?$", 1)
    part = lambda t: F.regexp_extract(t, r"\.(\d+)$", 1)
    most = F.lit("9" * 20).cast(TOKEN)
    left = F.greatest(F.length(whole(e)), F.length(whole(a)))
    right = F.greatest(F.length(part(e)), F.length(part(a)), F.lit(18))
    digits = lambda t: F.concat(F.lpad(whole(t), left, F.lit("0")), F.rpad(part(t), right, F.lit("0")))
    # How many leading digits agree.
    both = F.zip_with(F.split(digits(e), ""), F.split(digits(a), ""), lambda x, y: x == y)
    agree = F.coalesce(F.nullif(F.array_position(both, False), F.lit(0)), F.size(both) + 1) - 1
    rest = lambda t: F.substring(digits(t), (agree + 1).cast("int"), F.lit(1 << 30))
    more, less = F.greatest(rest(e), rest(a)), F.least(rest(e), rest(a))
    lead = F.left(more, F.lit(1)).cast("int") - F.left(less, F.lit(1)).cast("int")
    tail = lambda t: F.substring(t, F.lit(2), F.lit(1 << 30))
    # A lead of one is borrowed through all zeros that stand over nines; it is one still at the end of them.
    over = F.zip_with(F.split(tail(more), ""), F.split(tail(less), ""), lambda x, y: (x == "0") & (y == "9"))
    borrowed = F.when(lead == 1, F.coalesce(F.nullif(F.array_position(over, False), F.lit(0)), F.size(over) + 1) - 1).otherwise(0)
    near = lambda t: F.substring(tail(t), (borrowed + 1).cast("int"), F.lit(36))
    gap = F.try_subtract(F.concat(lead.cast("string"), near(more)).try_cast("decimal(38,0)"),
                         F.concat(F.lit("0"), near(less)).try_cast("decimal(38,0)"))
    # Decimals that the compared digits reach to.
    scale = F.least(left + right, agree + borrowed + 37) - left
    exact = F.concat(gap.cast("string"), F.lit("e"), (-scale).cast("string")).try_cast(TOKEN)
    unlike = e.startswith("-") != a.startswith("-")
    total = F.try_add(F.abs(_exact(e)), F.abs(_exact(a)))
    return (F.when(unlike, F.coalesce(total, most)).when(agree == F.size(both), F.lit(0).cast(TOKEN))
            .otherwise(F.coalesce(exact, F.when(scale < 18, most), F.lit(0).cast(TOKEN))))


def token_pairs(expected: Column, actual: Column) -> Column:
    """Two token lists side by side with the difference; tokens may be of any length."""

    def pair(e, a):
        plain = F.abs(F.try_subtract(_exact(e), _exact(a))).try_cast(TOKEN)
        gap = F.when(e == a, F.lit(0).cast(TOKEN)).otherwise(F.coalesce(plain, F.when(
            e.isNotNull() & a.isNotNull(), _long_gap(e, a))))
        return F.struct(e.alias("expected"), a.alias("actual"), gap.alias("diff"))

    return F.zip_with(expected, actual, pair)


def verdict(expected: Column, actual: Column, expected_tokens: Column, actual_tokens: Column, pairs: Column,
            tolerance: Column, strip_plus: bool = False) -> Column:
    """First rule that fails: counts, values (difference above the tolerance), comparability, labels."""
    return (
        F.when(expected.isNull() | actual.isNull(), "skipped")
        .when(F.size(expected_tokens) != F.size(actual_tokens), "count_mismatch")
        .when(F.exists(pairs, lambda p: p["diff"] > tolerance), "value_mismatch")
        .when(F.exists(pairs, lambda p: p["diff"].isNull()), "not_comparable")
        .when((expected != actual) & (label_text(expected, strip_plus) != label_text(actual, strip_plus)), "label_mismatch")
        .otherwise("pass")
    )
