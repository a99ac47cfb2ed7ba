"""Ordered, idempotent event processing on batch snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_free_prefix(inbox: DataFrame) -> DataFrame:
    """Events (connector, sequence, ...) that can be applied: those before the first gap.

    Sequences start at 1; an event applies if its place among the connector's
    events equals its sequence.
    """
    place = F.row_number().over(Window.partitionBy("connector").orderBy("sequence"))
    return inbox.withColumn("_n", place).where(F.col("_n") == F.col("sequence")).drop("_n")


def apply_changes(applied: DataFrame) -> DataFrame:
    """(connector, object, sequence, deleted, value): the newest change of each object;
    a deletion is a tombstone without a value."""
    best = F.max(F.struct("sequence", "change", "value")).alias("best")
    rows = applied.groupBy("connector", "object").agg(best)
    gone = F.col("best.change") == "DELETE"
    return rows.select("connector", "object", F.col("best.sequence").alias("sequence"), gone.alias("deleted"), F.when(~gone, F.col("best.value")).alias("value"))


def claimable(deliveries: DataFrame, now: Column) -> DataFrame:
    """Deliveries that are due and whose parent event isn't in the way: it is none,
    isn't known, or its delivery to the same consumer succeeded."""
    due = (F.col("status").isin("PENDING", "RETRY") & (F.col("next_at") <= now)) | ((F.col("status") == "CLAIMED") & (F.col("next_at") <= now))
    parent = deliveries.select(F.col("event_id").alias("parent_id"), F.col("consumer").alias("_consumer"), F.col("status").alias("_status"))
    mine = deliveries.where(due).join(parent, "parent_id", "left")
    open_gate = F.col("parent_id").isNull() | F.col("_status").isNull() | ((F.col("_consumer") == F.col("consumer")) & (F.col("_status") == "SUCCEEDED"))
    return mine.where(open_gate).select("event_id", "consumer")


def retry_delay(attempt: Column, unit: Column, base: float = 1.0, cap: float = 300.0, jitter: float = 0.2) -> Column:
    """Seconds to wait after an attempt: doubling from ``base``, up to ``cap``, moved by
    ``jitter`` as ``unit`` (0 to 1) says."""
    delay = F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1)) * (1 + (2 * unit - 1) * jitter)
    return F.least(F.lit(cap), F.round(delay, 3))


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """(connector, object, change, n): one change per object; a deletion dominates."""
    return changes.groupBy("connector", "object").agg(F.when(F.max((F.col("change") == "DELETE").cast("int")) == 1, "DELETE").otherwise("UPSERT").alias("change"), F.count("*").alias("n"))


def idempotent(appends: DataFrame) -> DataFrame:
    """(event_id, first_value, repeats, conflicts): an id seen again with the same
    content is a repeat, with other content a conflict.  ``appends``: (event_id, at, content)."""
    first = F.min(F.struct("at", "content")).alias("first")
    rows = appends.groupBy("event_id", "content").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    return rows.groupBy("event_id").agg(first, F.sum("n").alias("total"), F.count("*").alias("kinds")).select("event_id", F.col("first.content").alias("first_content"), (F.col("total") - F.col("kinds")).cast("long").alias("repeats"), (F.col("kinds") - 1).cast("long").alias("conflicts"))


def queue_summary(deliveries: DataFrame, now: Column) -> DataFrame:
    """Exclusive buckets per consumer in one conditional aggregate."""
    s, due = F.col("status"), F.col("next_at") <= now
    return deliveries.groupBy("consumer").agg(
        F.count_if((s == "PENDING") & due).alias("ready"),
        F.count_if((s == "PENDING") & ~due).alias("waiting"),
        F.count_if(s == "RETRY").alias("retry"),
        F.count_if(s == "CLAIMED").alias("claimed"),
        F.count_if(s == "SUCCEEDED").alias("succeeded"),
        F.count_if(s == "QUARANTINED").alias("quarantined"),
        F.count("*").alias("total"),
        F.min(F.when(s.isin("PENDING", "RETRY"), F.col("next_at"))).alias("next_wake"),
    )
