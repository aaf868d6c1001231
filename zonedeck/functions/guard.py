"""Keep rows whose computed values are all there, computing them once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_complete(df: DataFrame, values: dict[str, Column], kept: list[str], ok: Column | None = None) -> DataFrame:
    """``kept`` columns and ``values`` of the rows where ``ok`` holds (by default: where no value is NULL).

    A plain filter on computed columns is pushed below them and evaluates them a second time.  Here
    they are packed into a struct, and rows leave through a generator, which has to run after it.
    The test may use ``_v`` fields.
    """
    packed = df.select(*kept, F.struct(*[c.alias(n) for n, c in values.items()]).alias("_v"))
    if ok is None:
        ok = reduce(lambda a, b: a & b, [F.col(f"_v.{n}").isNotNull() for n in values])
    cells = F.struct(F.lit(True).alias("_kept"), *[F.col(f"_v.{n}").alias(n) for n in values])
    return packed.select(*kept, F.inline_outer(F.when(ok, F.array(cells)))).where(F.col("_kept")).drop("_kept")
