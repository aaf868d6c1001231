"""Exact decimal arithmetic: rounding modes, size errors, whole powers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A product of two decimals keeps its scale only while precision allows.  Five integer digits
#: leave 27 decimals (28 significant digits for a growth factor); ten integer digits leave 16.
FINE, WIDE = "decimal(32,27)", "decimal(26,16)"


def rounded(value: Column, scale: int, rounding: str = "half_up") -> Column:
    """Bring a decimal to ``scale``; ``half_up`` goes away from zero, ``truncate`` toward it."""
    if rounding == "half_up":
        return F.round(value, scale)
    if rounding == "truncate":
        return F.when(value < 0, F.ceil(value, F.lit(scale))).otherwise(F.floor(value, F.lit(scale)))
    raise ValueError("rounding is half_up or truncate")


def store(value: Column, digits: int, scale: int, rounding: str = "half_up") -> Column:
    """Result of a computation in a picture of ``digits``; NULL is the size error."""
    return rounded(value, scale, rounding).try_cast(f"decimal({digits},{scale})")


def _power(base: Column, exponent: Column, kind: str, bits: int) -> Column:
    """Square-and-multiply over the exponent's bits; the state is (result, square)."""
    start = F.struct(F.lit(1).cast(kind).alias("acc"), base.try_cast(kind).alias("square"))
    masks = F.slice(F.array(*[F.lit(1 << i) for i in range(bits)]), F.lit(1), F.length(F.bin(exponent)))
    state = F.aggregate(
        masks, start,
        lambda s, mask: F.struct(
            F.when(exponent.bitwiseAND(mask) != 0, (s["acc"] * s["square"]).try_cast(kind))
            .otherwise(s["acc"]).alias("acc"),
            (s["square"] * s["square"]).try_cast(kind).alias("square"),
        ),
    )
    return state["acc"]


def whole_power(base: Column, exponent: Column, bits: int = 31) -> Column:
    """``base ** exponent`` in exact decimals for exponents 0 to ``2**bits - 1``.

    Stays on the row it is computed for: a handful of products, no shuffle.  NULL means the
    result left ten integer digits or the exponent is outside its range.
    """
    exponent = exponent.cast("int")
    inside = exponent.between(0, (1 << bits) - 1)
    fine, wide = _power(base, exponent, FINE, bits), _power(base, exponent, WIDE, bits)
    both = "decimal(37,27)"
    return F.when(inside, F.coalesce(fine.cast(both), wide.cast(both)))
