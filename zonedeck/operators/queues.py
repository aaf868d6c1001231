"""Named queues with 1-based items, kept as a table ``(queue, item, data)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonedeck.operators.keyed import Changed, _found_or, _marked
from zonedeck.operators.lookup import lookup_join
from zonedeck.operators.ordering import position


def assign_queue_items(writes: DataFrame, order: list[str], existing: DataFrame | None = None,
                       buckets: int | None = None) -> DataFrame:
    """Append ``writes (queue, data[, length], ...)``; ``item`` continues after what the queue already holds.

    Queue names are trimmed; data is cut to ``length`` where that column is present.
    """
    named = writes.withColumn("queue", F.trim("queue"))
    if "length" in writes.columns:
        named = named.withColumn("data", F.left("data", F.col("length"))).drop("length")
    numbered = position(named, ["queue"], order, "item", buckets)
    if existing is None:
        return numbered
    held = existing.groupBy("queue").agg(F.max("item").alias("_held"))
    return (lookup_join(numbered, held, ["queue"])
            .withColumn("item", F.col("item") + F.coalesce(F.col("_held"), F.lit(0))).drop("_held"))


def read_queue_item(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Data and its length per ``(queue, item)`` request; an item out of range gets 26."""
    items = _marked(queue.select("queue", F.col("item").cast("bigint").alias("item"), "data"))
    asked = requests.withColumn("queue", F.trim("queue")).withColumn("item", F.col("item").cast("bigint"))
    return (lookup_join(asked, items, ["queue", "item"])
            .withColumn("length", F.length("data")).withColumn("resp", _found_or("ITEMERR")).drop("_found"))


def delete_queue(queue: DataFrame, names: DataFrame) -> Changed:
    """Drop whole queues; a name nothing is stored under gets 44.  A queue with most of the items is spread."""
    asked = names.select(F.trim("queue").alias("queue")).distinct()
    held = _marked(queue.select("queue").distinct())
    left = lookup_join(queue, _marked(asked), ["queue"]).where(F.col("_found").isNull()).select(*queue.columns)
    return Changed(left, asked.join(held, "queue", "left").select("queue", _found_or("QIDERR")))
