"""Keyed-file verbs as set operations.  Files are DataFrames with a unique key column.

Nothing is changed in place: a verb that writes returns the new state of the file and a
response per request.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonedeck.operators.lookup import lookup_join
from zonedeck.operators.ordering import running_total
from zonedeck.session import staged

# Response code names and numbers.
RESPONSES = {
    "NORMAL": 0,
    "ERROR": 1,
    "RDATT": 2,
    "WRBRK": 3,
    "EOF": 4,
    "EODS": 5,
    "EOC": 6,
    "INBFMH": 7,
    "ENDINPT": 8,
    "NONVAL": 9,
    "NOSTART": 10,
    "TERMIDERR": 11,
    "FILENOTFOUND": 12,
    "NOTFND": 13,
    "DUPREC": 14,
    "DUPKEY": 15,
    "INVREQ": 16,
    "IOERR": 17,
    "NOTOPEN": 18,
    "ENDFILE": 19,
    "ILLOGIC": 21,
    "LENGERR": 22,
    "QZERO": 23,
    "ITEMERR": 26,
    "PGMIDERR": 27,
    "TRANSIDERR": 28,
    "ENDDATA": 29,
    "MAPFAIL": 36,
    "QIDERR": 44,
    "DISABLED": 84,
}


class Changed(NamedTuple):
    file: DataFrame
    responses: DataFrame


def resp(name: str) -> Column:
    return F.lit(RESPONSES[name])


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("_found", F.lit(True))


def _found_or(name: str) -> Column:
    return F.when(F.col("_found"), resp("NORMAL")).otherwise(resp(name)).alias("resp")


def read_keyed(requests: DataFrame, file: DataFrame, key: str) -> DataFrame:
    """One lookup per request: the record's columns and ``resp`` (0, or 13 when there is none)."""
    joined = lookup_join(requests, _marked(file), [key])
    return joined.withColumn("resp", _found_or("NOTFND")).drop("_found")


def read_partial_key(requests: DataFrame, file: DataFrame, key: str, length: int) -> DataFrame:
    """The request key is cut to ``length`` characters and must then equal a file key.

    Where a file holds a key more than once, the record lowest in column order answers.
    """
    others = [c for c in file.columns if c != key]
    first = file.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(
        F.col(key).alias("_cut"), *[F.col("_r")[c].alias(c) for c in others], F.lit(True).alias("_found"))
    asked = requests.withColumn("_cut", F.left(F.col(key), F.lit(length)))
    return lookup_join(asked, first, ["_cut"]).withColumn("resp", _found_or("NOTFND")).drop("_found", "_cut")


def rewrite_keyed(file: DataFrame, updates: DataFrame, key: str, amount: str, into: str) -> Changed:
    """Read for update, add, rewrite.  Updates are summed per key before they meet the file.

    A key the file does not hold is reported with 13 and changes nothing.
    """
    summed = updates.groupBy(key).agg(F.sum(amount).alias("_add"), F.count(F.lit(1)).alias("updates"))
    kind = file.schema[into].dataType
    changed = (file.join(summed.select(key, "_add"), key, "left")
               .withColumn(into, (F.col(into) + F.coalesce(F.col("_add"), F.lit(0))).cast(kind))
               .select(*file.columns))
    responses = (summed.join(_marked(file.select(key)), key, "left")
                 .select(key, F.col("_add").alias(amount), "updates", _found_or("NOTFND")))
    return Changed(changed, responses)


def replace_keyed(file: DataFrame, updates: DataFrame, key: str, order: str) -> Changed:
    """Rewrite whole records; of several updates to a key the last by ``order`` stays."""
    others = [c for c in file.columns if c != key]
    last = updates.groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(order)).alias("_new"), F.count(F.lit(1)).alias("updates"))
    changed = file.join(last.select(key, "_new"), key, "left").select(
        *[F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
          for c in file.columns])
    responses = last.join(_marked(file.select(key)), key, "left").select(key, "updates", _found_or("NOTFND"))
    return Changed(changed, responses)


def _first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(order).alias(order))


def insert_keyed(file: DataFrame, rows: DataFrame, key: str, order: str) -> Changed:
    """Insert; a key already on file, or already inserted by an earlier row, gets 14.

    ``order`` must be unique in ``rows``.  Winners are found by partial aggregation and joined
    back on (key, order), which spreads even a key that a third of the batch repeats.
    """
    winners = (_first_per_key(rows, key, order).join(_marked(file.select(key)), key, "left")
               .select(key, order, F.when(F.col("_found"), resp("DUPREC")).otherwise(resp("NORMAL")).alias("resp")))
    # A NULL key equals other NULL keys here, as it does in the grouping that found the winner.
    won = winners.select(F.col(key).alias("_key"), F.col(order).alias("_order"), "resp")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order"))
    judged = rows.join(won, same, "left").drop("_key", "_order").withColumn("resp", F.coalesce("resp", resp("DUPREC")))
    added = judged.where(F.col("resp") == RESPONSES["NORMAL"]).select(*file.columns)
    return Changed(file.unionByName(added), judged)


def bulk_append(file: DataFrame, rows: DataFrame) -> DataFrame:
    """Append with no look at existing keys."""
    return file.unionByName(rows.select(*file.columns))


def bulk_append_to(path: str, rows: DataFrame) -> None:
    """The same onto a stored parquet file."""
    rows.write.mode("append").parquet(path)


def delete_keyed(file: DataFrame, requests: DataFrame, key: str, order: str | None = None) -> Changed:
    """Remove records; a key not on file, or already deleted by an earlier request, gets 13."""
    gone = requests.select(key).distinct()
    left = file.join(gone, key, "left_anti")
    if order is None:
        return Changed(left, read_keyed(requests, file.select(key), key))
    first = (_first_per_key(requests, key, order).join(_marked(file.select(key)), key, "left")
             .select(key, order, _found_or("NOTFND")))
    return Changed(left, requests.join(first, [key, order], "left").withColumn(
        "resp", F.coalesce("resp", resp("NOTFND"))))


def response_names(spark) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in RESPONSES.items()], "resp int, resp_name string")


def name_responses(df: DataFrame) -> DataFrame:
    """Add the symbolic name; the dimension is the fixed list above, so it is always small."""
    return df.join(F.broadcast(response_names(df.sparkSession)), "resp", "left")


def route_response(df: DataFrame, column: str = "resp") -> DataFrame:
    """Branch on the response: ``normal``, ``not_found``, ``duplicate`` or ``other``, with the flag to set."""
    code = F.col(column)
    route = (F.when(code == RESPONSES["NORMAL"], "normal").when(code == RESPONSES["NOTFND"], "not_found")
             .when(code == RESPONSES["DUPREC"], "duplicate").otherwise("other"))
    flag = F.when(code == RESPONSES["NOTFND"], "N").when(code == RESPONSES["DUPREC"], "D")
    return df.withColumn("route", route).withColumn("found_flag", flag)


def move_corresponding(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """Overwrite in ``dst`` only the columns that ``src`` has under the same name."""
    shared = [c for c in dst.columns if c in src.columns and c != key]
    given = src.select(key, F.struct(*shared).alias("_src"))
    joined = lookup_join(dst, given, [key])
    return joined.select(*[
        F.when(F.col("_src").isNotNull(), F.col("_src")[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)
        for c in dst.columns])


def browse(file: DataFrame, key: str, start, limit: int, reverse: bool = False) -> DataFrame:
    """Records from ``start`` on in key order (or back from it), at most ``limit``."""
    inside = F.col(key) <= F.lit(start) if reverse else F.col(key) >= F.lit(start)
    return file.where(inside).orderBy(F.desc(key) if reverse else F.asc(key)).limit(limit)


def _starts_among(requests: DataFrame, start: str, records: DataFrame, key: str, weight: Column,
                  starts_first: bool, descending: bool = False, carried: list[str] = ()) -> DataFrame:
    """Distinct start keys and records in one order, with the running weight of the records as ``_run``.

    Stored, so that the order is made once; records keep their columns ``carried``.
    """
    zero = F.lit(0).cast(records.select(weight.alias("w")).schema["w"].dataType)
    kind = records.schema[key].dataType
    starts = requests.select(F.col(start).cast(kind).alias("_k")).distinct()
    nothing = [F.lit(None).cast(records.schema[c].dataType).alias(c) for c in carried]
    both = (starts.select("_k", F.lit(0 if starts_first else 1).alias("_side"), F.lit(True).alias("_is_start"),
                          zero.alias("_w"), *nothing)
            .unionByName(records.select(F.col(key).alias("_k"), F.lit(1 if starts_first else 0).alias("_side"),
                                        F.lit(False).alias("_is_start"), weight.alias("_w"), *carried)))
    return staged(running_total(both.where(F.col("_k").isNotNull()), [], ["_k", "_side"], F.col("_w"), "_run", descending=descending),
                  "browse-order")


def browse_many(requests: DataFrame, file: DataFrame, key: str, start: str, reads: int,
                reverse: bool = False) -> DataFrame:
    """``reads`` sequential reads per request from its start key; reads past the end get 19.

    Start keys and whole records are put in one order and counted through it, which gives each
    record its position and each start key the position it begins at.  The reads then are
    equi-joins on position, so no request is compared with every record.
    """
    others = [c for c in file.columns if c != key]
    counted = _starts_among(requests, start, file, key, F.lit(1).cast("bigint"), not reverse, carried=others)
    begins = counted.where("_is_start").select(F.col("_k").alias("_start"), F.col("_run").alias("_from"))
    asked = lookup_join(requests.withColumn("_start", F.col(start).cast(file.schema[key].dataType)), begins, ["_start"])
    steps = asked.withColumn("read_no", F.explode(F.sequence(F.lit(1), F.lit(reads))))
    at = F.col("_from") - F.col("read_no") + 1 if reverse else F.col("_from") + F.col("read_no")
    stored = counted.where(~F.col("_is_start")).select(F.col("_k").alias(key), *others, F.col("_run").alias("_pos"))
    return (lookup_join(steps.withColumn("_pos", at), _marked(stored), ["_pos"])
            .withColumn("resp", _found_or("ENDFILE")).drop("_found", "_pos", "_start", "_from"))


def browse_total(file: DataFrame, key: str, amount: str, start: str, mode: str = "prefix") -> DataFrame:
    """Sum over a browse: of keys that begin with ``start``, or (``to_end``) of all keys from it on."""
    inside = F.col(key).startswith(start) if mode == "prefix" else F.col(key) >= start
    return file.where(inside).agg(F.coalesce(F.sum(amount), F.lit(0).cast("decimal(38,2)")).alias("total"))


def browse_totals(requests: DataFrame, file: DataFrame, key: str, amount: str, request_id: str, start: str,
                  length: int, mode: str = "prefix") -> DataFrame:
    """The same for many requests at once; ``length`` is the common length of the start keys."""
    zero = F.lit(0).cast("decimal(38,2)")
    cut = file.groupBy(F.left(F.col(key), F.lit(length)).alias("_cut")).agg(F.sum(amount).alias("_sum"))
    if mode == "prefix":
        joined = lookup_join(requests.withColumn("_cut", F.col(start)), cut, ["_cut"])
        return joined.select(request_id, F.coalesce("_sum", zero).cast("decimal(38,2)").alias("total"))
    # Records at or after a start key of this length are exactly those whose cut key is.
    sums = _starts_among(requests, start, cut, "_cut", F.col("_sum").cast("decimal(38,2)"),
                         starts_first=True, descending=True)
    begins = sums.where("_is_start").select(F.col("_k").alias(start), F.col("_run").cast("decimal(38,2)").alias("total"))
    return lookup_join(requests, begins, [start]).select(request_id, "total")
