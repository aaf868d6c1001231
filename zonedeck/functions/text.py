"""String verbs and intrinsic functions on text columns, and edited pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonedeck.functions.codec import BLANKS


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def numval(value: Column, digits: int = 18, scale: int = 2) -> Column:
    """Number in a text; NULL when there is none."""
    return trim(value).try_cast(f"decimal({digits},{scale})")


def move_text(value: Column, length: int) -> Column:
    """Move to an alphanumeric item: blanks on the right, or cut to length."""
    return F.rpad(value, length, " ")


def string_by_space(*values: Column, first_word: bool = False) -> Column:
    """Join items delimited by space: trailing blanks dropped, or (``first_word``) only up to the first blank."""
    cut = (lambda v: F.substring_index(v, " ", 1)) if first_word else (lambda v: F.rtrim(v))
    return F.concat(*[cut(v) for v in values])


def unstring(value: Column, delimiter: str = ",") -> tuple[Column, Column]:
    """Before and after the first delimiter; without one the second part is NULL."""
    at = F.instr(value, delimiter)
    head = F.when(at == 0, value).otherwise(F.left(value, at - 1))
    tail = F.when(at > 0, F.substring(value, at + len(delimiter), F.length(value)))
    return head, tail


def tally(value: Column, piece: str) -> Column:
    """Occurrences of a piece that do not overlap."""
    return F.floor((F.length(value) - F.length(F.replace(value, F.lit(piece), F.lit("")))) / len(piece))


def inspect_replacing(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def inspect_converting(value: Column, old: str, new: str) -> Column:
    return F.translate(value, old, new)


def largest(*values: Column) -> Column:
    """MAX of the arguments; NULLs do not take part."""
    return F.greatest(*values)


def smallest(*values: Column) -> Column:
    """MIN of the arguments; NULLs do not take part."""
    return F.least(*values)


def modulo(value: Column, divisor: Column) -> Column:
    """MOD: the remainder has the sign of the divisor; NULL for a zero divisor."""
    rest = F.try_mod(value, divisor)
    return F.when((rest != 0) & ((rest < 0) != (divisor < 0)), rest + divisor).otherwise(rest)


def absolute(value: Column) -> Column:
    return F.abs(value)


def edited_count(value: Column, width: int) -> Column:
    """``Z(width)``: leading zeros blank, zero is all blanks.  A number that is too wide is shown in full."""
    return F.when(value == 0, F.repeat(F.lit(" "), F.lit(width))).otherwise(_wide(value.cast("string"), width))


def edited_amount(value: Column, blanks: int, scale: int = 2) -> Column:
    """``Z(blanks)9.99``: at least one digit before the point.  An amount that is too wide is shown in full."""
    return _wide(value.cast(f"decimal(38,{scale})").cast("string"), blanks + 2 + scale)


def _wide(digits: Column, width: int) -> Column:
    """Blanks on the left; unlike a plain pad this never cuts."""
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit(" "))
