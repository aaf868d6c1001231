"""Small helpers shared by the operators: staged tables, Arrow passes over a text column, table sizes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.session import shared_dir

#: ASCII blanks that separate words: \x20 and \x09 to \x0D.  ``bytes.split()`` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
#: The same words as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes an Arrow pass looks at together.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets a finished write drop the shuffle files that only it used.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation.

    The shuffle files behind the write go as soon as it is done, so that steps do not add up on disk.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``limit`` text bytes; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def with_python(df: DataFrame, text: str, fields: list[T.StructField],
                make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """Append columns computed from a text column in Arrow batches.

    ``make`` runs once per task and gives a function from UTF-8 texts (null as empty) to one array per field.
    Rows keep their order and all their columns; the pass neither shuffles nor holds more than a slice.
    """
    types = [to_arrow(f.dataType) for f in fields]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        collecting = gc.isenabled()
        gc.disable()  # slices make long lists and no cycles; walking those lists again and again costs a third
        try:
            for batch in batches:
                for part in text_slices(batch, text, limit):
                    texts = [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
                    arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(compute(texts), types)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays],
                                                     [*part.schema.names, *[f.name for f in fields]])
        finally:
            if collecting:
                gc.enable()

    return df.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; other columns, whatever their names, stay out."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Starts of items of the given lengths laid end to end, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
