"""Batch jobs over typed records: totals, postings, interest, loans, payroll, dates, report lines."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.functions import clock, text
from zonedeck.functions.guard import keep_complete
from zonedeck.functions.money import FINE, store, whole_power


class Posted(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def control_totals(records: DataFrame, status: str, amount: str, by: list[str] | None = None,
                   accepted: str = "A") -> DataFrame:
    """Accepted count and sum; every other status counts as an error.  One pass with map-side combine."""
    ok = F.col(status) == accepted
    zero = F.lit(0).cast("decimal(14,2)")
    return records.groupBy(*(by or [])).agg(
        F.count_if(ok).alias("record_count"),
        F.coalesce(F.sum(F.when(ok, F.col(amount))), zero).alias("total_amount"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("error_count"))


def report_lines(totals: DataFrame) -> DataFrame:
    """The edited summary line over control totals, items joined without a separator."""
    return totals.withColumn("line", F.concat(
        text.edited_count(F.col("record_count"), 9), F.lit(" / "),
        text.edited_count(F.col("error_count"), 9), F.lit(" TOTAL: $"),
        text.edited_amount(F.col("total_amount"), 9)))


def _cut_quotient(dividend: Column, divisor: Column, digits: int, scale: int, kind: str, back: str) -> Column:
    over, under = dividend.try_cast(kind), divisor.try_cast(kind)
    quotient = store(F.try_divide(over, under), digits, scale, "truncate")
    # A quotient of few decimals may have been rounded up on its way; it never takes more than there is.
    step = F.lit(f"1e-{scale}").cast(f"decimal({digits},{scale})")
    taken = (quotient * under).try_cast(back)
    return F.when(F.abs(taken) > F.abs(over), quotient - F.signum(quotient).cast("int") * step).otherwise(quotient).try_cast(
        f"decimal({digits},{scale})")


def divide_remainder(dividend: Column, divisor: Column, digits: int, scale: int) -> tuple[Column, Column]:
    """Quotient cut (never rounded) to its picture, and what is left over; NULL for a zero divisor.

    Operands are taken with ten decimals, which leaves the quotient at least as many; operands that have more, with
    eighteen, which leaves it six.
    """
    coarse = F.coalesce((dividend.try_cast("decimal(28,10)") == dividend) & (divisor.try_cast("decimal(28,10)") == divisor), F.lit(True))
    quotient = F.when(coarse, _cut_quotient(dividend, divisor, digits, scale, "decimal(28,10)", "decimal(38,12)")).otherwise(
        _cut_quotient(dividend, divisor, digits, scale, "decimal(38,18)", "decimal(38,18)"))
    return quotient, F.try_subtract(dividend, F.try_multiply(quotient, divisor))


def post_amounts(df: DataFrame, price: str, quantity: str, discount: str, rounding: str = "half_up",
                 digits: int = 11, scale: int = 2) -> Posted:
    """ADD, SUBTRACT, MULTIPLY, DIVIDE and COMPUTE over a line, each result in a picture of its own.

    Any result that does not fit (size error), or a division by zero, sends the row to ``rejects``.
    """
    p, q, d = F.col(price), F.col(quantity), F.col(discount)
    quotient, remainder = divide_remainder(p, q, digits, scale)
    results = {
        "line_total": store(p * q, digits, scale, rounding),
        "net_price": store(p * (1 - d), digits, scale, rounding),
        "discount_amount": store(p - store(p * (1 - d), digits, scale, rounding), digits, scale, rounding),
        "price_plus": store(p + q, digits, scale, rounding),
        "unit_price": quotient,
        "unit_remainder": remainder.try_cast(f"decimal({digits},{scale + 2})"),
    }
    fits = reduce(lambda a, b: a & b, [F.col(f"_v.{n}").isNotNull() for n in results])
    rejects = keep_complete(df, results, df.columns, ~fits).select(*df.columns)
    return Posted(keep_complete(df, results, df.columns, fits), rejects)


def compound_interest(principal: Column, annual_rate: Column, per_year: Column, years: Column,
                      rounding: str = "half_up", digits: int = 14, scale: int = 2) -> Column:
    """Principal grown at ``annual_rate`` percent, compounded ``per_year`` times; NULL is the size error."""
    step = annual_rate.cast(FINE) / (per_year.cast("int") * 100).cast("decimal(6,0)")
    growth = whole_power((1 + step).cast(FINE), per_year * years)
    return store((principal * growth), digits, scale, rounding)


def simple_interest(principal: Column, rate: Column, time: Column, rounding: str = "half_up",
                    digits: int = 14, scale: int = 2) -> Column:
    return store((principal * rate * time).cast("decimal(38,8)") * F.lit("0.01").cast("decimal(3,2)"),
                 digits, scale, rounding)


def loan_payment(amount: Column, annual_rate: Column, years: Column, rounding: str = "half_up") -> Column:
    """Level monthly payment; the monthly rate is stored with eight decimals before it is used."""
    monthly = store(annual_rate.cast("decimal(20,12)") / F.lit(1200).cast("decimal(4,0)"), 13, 8, rounding)
    growth = whole_power((1 + monthly).cast(FINE), years * 12)
    shrink = F.try_divide(F.lit(1).cast("decimal(1,0)"), growth.try_cast("decimal(22,17)"))
    paid = (amount * monthly).cast("decimal(22,10)")
    return store(F.try_divide(paid, (1 - shrink).cast("decimal(19,18)")), 11, 2, rounding)


def payroll(df: DataFrame, hours: str, rate: str, tax_rate: str, overtime: bool = False,
            rounding: str = "half_up") -> DataFrame:
    """Gross, tax and net, every intermediate stored in two decimals."""
    h, r = F.col(hours), F.col(rate)
    half = F.lit("1.5").cast("decimal(2,1)")
    earned = h * r
    if overtime:
        earned = F.when(h > 40, 40 * r + (h - 40) * r * half).otherwise(h * r)
    return (df.withColumn("gross_pay", store(earned, 11, 2, rounding))
            .withColumn("tax_amount", store(F.col("gross_pay") * F.col(tax_rate) * F.lit("0.01").cast("decimal(3,2)"),
                                            11, 2, rounding))
            .withColumn("net_pay", store(F.col("gross_pay") - F.col("tax_amount"), 11, 2, rounding)))


def payroll_lines(df: DataFrame) -> Column:
    """The three display lines of a payroll row."""
    return F.concat(F.lit("Gross Pay  : "), F.col("gross_pay").cast("string"), F.lit("\nTax Amount : "),
                    F.col("tax_amount").cast("string"), F.lit("\nNet Pay    : "), F.col("net_pay").cast("string"))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Number forms of a timestamp and the way back from each."""
    day = F.to_date(ts)
    return df.withColumns({
        "yyyymmdd": clock.yyyymmdd(day),
        "yymmdd": clock.yymmdd(day),
        "day_number": clock.integer_of_date(day),
        "abstime": clock.abstime(F.col(ts)),
    }).withColumns({
        "day_back": clock.date_of_integer(F.col("day_number")),
        "date_back": clock.date_of_yyyymmdd(F.col("yyyymmdd")),
        "clock_time": clock.clock_text(clock.time_of_abstime(F.col("abstime"))),
    })


