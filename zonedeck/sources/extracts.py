"""Loading, looking up, converting and writing binary extracts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.functions import codec
from zonedeck.layout import Layout
from zonedeck.operators.lookup import lookup_join
from zonedeck.session import fits_broadcast
from zonedeck.sources import fixedbin


class Loaded(NamedTuple):
    good: DataFrame
    bad: DataFrame


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme belongs to the default file system of the cluster, as for Spark's own sources."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if ":" in path or default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def read_records(spark: SparkSession, path: str, reclen: int, mode: str = "failfast",
                 file_column: bool = False, split_bytes: int | None = None) -> DataFrame:
    """``(rrn, rec[, file])`` of every record; a short tail arrives as a short record in permissive mode."""
    fixedbin.register(spark)
    reader = (spark.read.format("fixedbin").option("path", qualified(spark, path)).option("reclen", reclen)
              .option("mode", mode).option("filecolumn", str(file_column).lower()))
    if split_bytes:
        reader = reader.option("splitbytes", split_bytes)
    return reader.load()


def decode_records(records: DataFrame, layout: Layout, strip: str = "both", checked: bool = True) -> DataFrame:
    """Typed columns beside whatever else ``records`` carries; unread columns are never decoded."""
    shown = codec.decode_columns(F.col("rec"), layout, strip, checked)
    flags = codec.condition_columns(layout, shown)
    kept = [F.col(c) for c in records.columns if c != "rec"]
    return records.select(*kept, *[c.alias(n) for n, c in {**shown, **flags}.items()])


def explode_occurs(df: DataFrame, name: str, position: str = "entry") -> DataFrame:
    """One row per repeat of an OCCURS item, numbered from 1, its parts as columns.

    The outer form keeps Spark from decoding the array a second time just to test that it is not empty.
    """
    kept = [c for c in df.columns if c != name]
    item = df.schema[name].dataType.elementType
    rows = df.select(*kept, F.posexplode_outer(name).alias("_at", "_item")).where(F.col("_at").isNotNull())
    parts = [F.col("_item.*")] if isinstance(item, T.StructType) else [F.col("_item").alias(name)]
    return rows.select(*kept, (F.col("_at") + 1).alias(position), *parts)


def split_records(records: DataFrame, layout: Layout, strip: str = "both") -> Loaded:
    """Decodable records as typed columns, and the rest with the reason they were set aside."""
    columns = codec.decode_columns(F.col("rec"), layout, strip)
    judged = records.withColumn("reason", codec.reject_reason(F.col("rec"), layout, columns))
    good = decode_records(judged.where(F.col("reason").isNull()).drop("reason"), layout, strip, checked=False)
    return Loaded(good, judged.where(F.col("reason").isNotNull()))


def load_fixed(spark: SparkSession, path: str, layout: Layout, mode: str = "failfast",
               strip: str = "both", file_column: bool = False) -> DataFrame | Loaded:
    """Decode an extract.

    ``failfast`` returns one DataFrame: an incomplete tail raises when the file is
    planned, damaged bytes raise when the damaged column is read.  ``permissive``
    returns ``(good, bad)``.
    """
    records = read_records(spark, path, layout.width, mode, file_column)
    if mode == "failfast":
        return decode_records(records, layout, strip)
    if mode == "permissive":
        return split_records(records, layout, strip)
    raise ValueError("mode is failfast or permissive")


def lookup_rrn(records: DataFrame, wanted: DataFrame, mode: str = "failfast") -> DataFrame:
    """Random access by 1-based record number: each wanted ``rrn`` with its bytes, or NULL past the end.

    A wanted list within the broadcast bound reduces the file on the map side, so only
    records that were asked for are shuffled.
    """
    asked = F.col("rrn")
    if mode == "failfast":
        asked = F.when(asked < 1, F.raise_error(F.concat(F.lit("record numbers start at 1; got "), asked)))\
            .otherwise(asked)
    wanted = wanted.withColumn("rrn", asked)
    numbers = wanted.select("rrn").distinct()
    if fits_broadcast(numbers):
        records = records.join(F.broadcast(numbers), "rrn", "left_semi")
    return lookup_join(wanted, records, ["rrn"])


def encode_fixed(df: DataFrame, layout: Layout, mode: str = "failfast", rounding: str = "half_up") -> DataFrame:
    """Add ``rec``, the record's bytes.  A value that does not fit raises, or leaves ``rec`` NULL (permissive)."""
    # A text FILLER that the rows do not have is blank.
    blank = {f.name for f in layout.fields if f.kind == "text" and f.name.startswith("filler") and f.name not in df.columns}
    rec = codec.encode_record(layout, {f.name: F.lit("") if f.name in blank else F.col(f.name)
                                       for f in layout.fields if not f.redefines}, rounding)
    if mode == "failfast":
        rec = F.coalesce(rec, F.raise_error(F.lit(f"a value does not fit layout {layout.name}")))
    return df.withColumn("rec", rec)


def write_records(records: DataFrame, reclen: int, path: str, mode: str = "append") -> None:
    """Write ready-made ``rec`` bytes, one file per task."""
    fixedbin.register(records.sparkSession)
    records.select("rec").write.format("fixedbin").option("path", qualified(records.sparkSession, path)).option("reclen", reclen).mode(mode).save()


def write_fixed(df: DataFrame, layout: Layout, path: str, rounding: str = "half_up", mode: str = "append") -> None:
    """Write typed rows as record files."""
    write_records(encode_fixed(df, layout, "failfast", rounding), layout.width, path, mode)


def convert_extract(spark: SparkSession, path: str, layout: Layout, out: str, fmt: str = "csv") -> int:
    """Binary extract to delimited text with a header (or parquet); returns the number of records."""
    seen = Observation("converted")
    rows = load_fixed(spark, path, layout).drop("rrn").observe(seen, F.count(F.lit(1)).alias("records"))
    writer = rows.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(out)
    else:
        writer.format(fmt).save(out)
    return seen.get["records"]
