"""Queues and arriving files as streams, with exactly-once file sinks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonedeck.operators.batch import control_totals
from zonedeck.operators.keyed import RESPONSES


def consume_queue(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Destructive read: each item reaches ``out`` once; the checkpoint remembers what was taken."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


class QueueRun(NamedTuple):
    query: StreamingQuery
    out: str
    batches: list[int]
    spark: SparkSession


def consume_counted(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> QueueRun:
    """The same with every batch in a folder of its own, so that a run can tell what it took.

    A batch that is repeated after a failure replaces its own folder.  Of a run only its first and last batch number
    are kept.  ``read_taken`` reads the items.
    """
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/taken_in={number}")
        batches[:] = [min([number, *batches]), max([number, *batches])]

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return QueueRun((writer.trigger(availableNow=True) if available_now else writer).start(), out, batches, stream.sparkSession)


def read_taken(spark: SparkSession, out: str) -> DataFrame:
    """All items that ``consume_counted`` took, whatever run it was."""
    return spark.read.parquet(out).drop("taken_in")


def taken(run: QueueRun) -> int:
    """Items of a finished run that reached its folder, counted there: the batches of the run, however many."""
    if not run.batches:
        return 0
    return run.spark.read.parquet(run.out).where(F.col("taken_in").between(*run.batches)).count()


def queue_state(consumed: int) -> int:
    """Response of one read attempt: 0 when it took something, 23 when the queue was empty."""
    return RESPONSES["NORMAL"] if consumed else RESPONSES["QZERO"]


def append_log(stream: DataFrame, out: str, checkpoint: str, message: str = "message", length: str = "length",
               available_now: bool = True) -> StreamingQuery:
    """Append messages cut to their length, blanks at the end dropped."""
    cut = F.regexp_replace(F.left(F.col(message), F.col(length)), r"\s+$", "")
    return consume_queue(stream.withColumn(message, cut).drop(length), out, checkpoint, available_now)


def windowed_totals(records: DataFrame, ts: str, status: str, amount: str, window: str = "1 day",
                    late: str = "1 hour") -> DataFrame:
    """Control totals per event-time window; the watermark bounds how long a window is kept open."""
    timed = records.withWatermark(ts, late) if records.isStreaming else records
    totals = control_totals(timed.withColumn("_w", F.window(ts, window)), status, amount, by=["_w"])
    return totals.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                         "record_count", "total_amount", "error_count")


def control_totals_stream(records: DataFrame, ts: str, status: str, amount: str, out: str, checkpoint: str,
                          window: str = "1 day", late: str = "1 hour", output_mode: str = "append",
                          available_now: bool = True) -> StreamingQuery:
    """Running control totals.

    ``append`` writes a window once, when the watermark has passed it; state stays bounded, and rows
    later than the watermark are dropped by Spark.  ``complete`` rewrites all windows with every batch.
    Where late rows must count, use ``control_totals_partials``.
    """
    totals = windowed_totals(records, ts, status, amount, window, late)
    writer = totals.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode)
    if output_mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Event time of the rows that close a stream: later than any other.
CLOSING = "9999-01-01 00:00:00"


def with_closing(records: DataFrame, folder: str) -> DataFrame:
    """A stream of records that also takes what ``close_stream`` puts into a folder."""
    spark = records.sparkSession
    spark.createDataFrame([], records.schema).write.mode("append").parquet(folder)
    return records.unionByName(spark.readStream.schema(records.schema).parquet(folder))


def close_stream(spark: SparkSession, folder: str, schema, ts: str, start) -> None:
    """Write the windows that are still open: nothing comes after this.

    ``start`` starts the query once more over the same checkpoint.  A row of the far future moves the watermark past
    every window; a second one makes a batch that sees it, writes the windows and drops their state.  The rows' own
    window stays open and is never written.
    """
    for _ in range(2):
        row = spark.range(1).select(*[F.lit(CLOSING if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema])
        row.write.mode("append").parquet(folder)
        start().awaitTermination()


def control_totals_partials(records: DataFrame, ts: str, status: str, amount: str, out: str, checkpoint: str,
                            window: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Running control totals that never leave a row out, however late it comes, and hold no state.

    Each batch is totalled by itself into a folder named after it, so a repeated batch replaces its own
    output.  ``read_totals`` adds the batches up.
    """

    def keep(batch: DataFrame, number: int) -> None:
        windowed_totals(batch, ts, status, amount, window).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals per window over all batches written so far."""
    return (spark.read.parquet(out).groupBy("window_start", "window_end")
            .agg(F.sum("record_count").alias("record_count"), F.sum("total_amount").alias("total_amount"),
                 F.sum("error_count").alias("error_count")))
