"""Queries that run a stream over the events table to its end and return what reached the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.plans import carriers as C
from zonedeck.plans.registry import query
from zonedeck.session import shared_dir
from zonedeck.streaming import feeds


def arriving(spark, sf_dir):
    """The events table as a file stream; the pattern matches exactly its file."""
    schema = C.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("consume_queue", "SELECT event_id, event_type AS queue, props AS data FROM events")
def consume_queue(spark, sf_dir):
    """Two runs over one checkpoint: the second finds the queue empty and adds nothing."""
    out, checkpoint = shared_dir(spark, "consumed"), shared_dir(spark, "consumed-state")
    for _ in range(2):
        stream = arriving(spark, sf_dir).select("event_id", F.col("event_type").alias("queue"), F.col("props").alias("data"))
        feeds.consume_queue(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("consume_queue_responses", """
    SELECT 1 AS attempt, count(*) AS items, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 23 END AS INTEGER) AS resp FROM events
    UNION ALL SELECT 2, 0, 23""")
def consume_queue_responses(spark, sf_dir):
    """Each attempt with what it took and its response: the second one finds the queue empty."""
    out, checkpoint = shared_dir(spark, "taken"), shared_dir(spark, "taken-state")
    found = []
    for attempt in (1, 2):
        run = feeds.consume_counted(arriving(spark, sf_dir).select("event_id"), out, checkpoint)
        run.query.awaitTermination()
        items = feeds.taken(run)
        found.append((attempt, items, feeds.queue_state(items)))
    return spark.createDataFrame(found, "attempt int, items bigint, resp int")


@query("append_log", "SELECT event_id, rtrim(left(concat(event_type, '    ', props), 10)) AS message FROM events")
def append_log(spark, sf_dir):
    out, checkpoint = shared_dir(spark, "log"), shared_dir(spark, "log-state")
    messages = arriving(spark, sf_dir).select(
        "event_id", F.concat("event_type", F.lit("    "), "props").alias("message"), F.lit(10).alias("length"))
    feeds.append_log(messages, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("control_totals_windows", """
    SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS record_count,
           CAST(coalesce(sum(CAST(value AS DECIMAL(11,2))) FILTER (event_type <> 'error'), 0) AS DECIMAL(21,2)) AS total_amount,
           count(*) FILTER (event_type = 'error') AS error_count
    FROM events GROUP BY 1""")
def control_totals_windows(spark, sf_dir):
    """Each window written once, when the watermark has passed it; closing the stream writes the last ones."""
    out, checkpoint, closing = shared_dir(spark, "windows"), shared_dir(spark, "windows-state"), shared_dir(spark, "windows-closing")

    def start():
        records = arriving(spark, sf_dir).select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(11,2)").alias("amount"),
            F.when(F.col("event_type") == "error", "E").otherwise("A").alias("status"))
        start.schema = records.schema
        return feeds.control_totals_stream(feeds.with_closing(records, closing), "ts", "status", "amount", out, checkpoint)

    start().awaitTermination()
    feeds.close_stream(spark, closing, start.schema, "ts", start)
    return spark.read.parquet(out).select(
        F.to_date("window_start").alias("day"), "record_count",
        F.coalesce("total_amount", F.lit(0)).cast("decimal(21,2)").alias("total_amount"), "error_count")


@query("control_totals_stream", """
    SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS record_count,
           CAST(coalesce(sum(CAST(value AS DECIMAL(11,2))) FILTER (event_type <> 'error'), 0) AS DECIMAL(21,2)) AS total_amount,
           count(*) FILTER (event_type = 'error') AS error_count
    FROM events GROUP BY 1""")
def control_totals_stream(spark, sf_dir):
    """All windows, the open one and late rows included."""
    out, checkpoint = shared_dir(spark, "totals"), shared_dir(spark, "totals-state")
    records = arriving(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(11,2)").alias("amount"),
        F.when(F.col("event_type") == "error", "E").otherwise("A").alias("status"))
    feeds.control_totals_partials(records, "ts", "status", "amount", out, checkpoint).awaitTermination()
    return feeds.read_totals(spark, out).select(
        F.to_date("window_start").alias("day"), "record_count",
        F.col("total_amount").cast("decimal(21,2)").alias("total_amount"), "error_count")
