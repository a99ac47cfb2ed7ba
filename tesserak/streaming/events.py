"""Streams over the events table, run until all available rows are done.

Each returns what its sink holds.  Sinks and checkpoints lie in the folder that
the session's cluster shares.
"""

from __future__ import annotations

import json
import uuid
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.graph import shared_dir
from ..sources import bind


def own_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with event times."""
    schema = bind.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its sink."""
    spark, at = stream.sparkSession, own_dir(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", at + "/state").option("path", at + "/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at + "/rows")


def upserted(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Like drained(), for aggregates that change: each batch appends its updates with
    the batch's number, and the newest row of a key counts."""
    spark, at = stream.sparkSession, own_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", at + "/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(at + "/rows").drop("batch")
    rest = [c for c in rows.columns if c not in [*keys, "_batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_events(spark, sf_dir).withWatermark("ts", "2 days")
    counts = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
    out = upserted(flat, ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that closed: those before the watermark."""
    e = read_events(spark, sf_dir).withWatermark("ts", "1 hour")
    closed = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(closed.select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n"))


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent intake: an event id counts once within the watermark."""
    e = read_events(spark, sf_dir).withWatermark("ts", "40 days")
    return drained(e.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"))


_OUT = "connector long, sequence long, object string, change string, value double"
#: Sequence numbers whose waiting events are one state entry; rows of a
#: connector that are held at once.
CHUNK, AT_ONCE = 128, 10_000


class GapOrdered(StatefulProcessor):
    """Applies a connector's events in sequence; later ones wait until the gap closes.

    What waits is one state entry for every ``CHUNK`` sequence numbers, so a batch reads
    and writes the entries of its own events and of those that come free, however long
    the backlog is, and not each event by itself.  A sequence that was applied, or waits,
    is passed over when it comes again.
    """

    def init(self, handle) -> None:
        self.applied = handle.getValueState("applied", "sequence long")
        self.waiting = handle.getMapState("waiting", "chunk long", "events string")

    def handleInputRows(self, key, rows, timerValues):
        was = self.applied.get()
        first = was[0] if was else 0
        applied, backlog = first, self.waiting.exists()
        while come := list(islice(rows, AT_ONCE)):
            come.sort(key=lambda r: r.sequence)
            new: dict[int, tuple] = {}
            for r in come:
                if r.sequence > applied:
                    new.setdefault(r.sequence, (r.object, r.change, r.value))
            held: dict[int, dict[int, tuple]] = {}
            changed = set()
            while True:
                row, number = new.pop(applied + 1, None), (applied + 1) // CHUNK
                if backlog and applied + 1 in self._chunk(held, number):  # it came before
                    row = held[number].pop(applied + 1)
                    changed.add(number)
                if row is None:
                    break
                applied += 1
                yield Row(connector=key[0], sequence=applied, object=row[0], change=row[1], value=row[2])
            for sequence, row in new.items():
                number = sequence // CHUNK
                chunk = self._chunk(held, number) if backlog else held.setdefault(number, {})
                if sequence not in chunk:
                    chunk[sequence] = row
                    changed.add(number)
            for number in changed:
                if held[number]:
                    self.waiting.updateValue((number,), (json.dumps([[n, *row] for n, row in held[number].items()]),))
                else:
                    self.waiting.removeKey((number,))
            backlog = backlog or bool(changed)
        if applied > first:
            self.applied.update((applied,))

    def _chunk(self, held: dict[int, dict[int, tuple]], number: int) -> dict[int, tuple]:
        """The waiting events of a chunk by sequence, read once for the rows at hand."""
        if number not in held:
            there = self.waiting.containsKey((number,))
            held[number] = {n: tuple(row) for n, *row in json.loads(self.waiting.getValue((number,))[0])} if there else {}
        return held[number]

    def close(self) -> None:
        pass


#: The state store that keeps entries of a map apart.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gap_ordered_changes(inbox: DataFrame) -> DataFrame:
    """A stream (connector, sequence, object, change, value) in order, without what
    comes after a gap."""
    inbox.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return inbox.groupBy("connector").transformWithState(statefulProcessor=GapOrdered(), outputStructType=_OUT, outputMode="append", timeMode="none")


def gap_ordered_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin of the batch operator, over the bound inbox written as files."""
    from ..operators.ordered import apply_changes

    at = own_dir(spark)
    inbox = bind.inbox(spark, sf_dir).select("connector", "sequence", "object", "change", "value")
    part = F.pmod(F.xxhash64("connector", "sequence"), F.lit(3))
    inbox.withColumn("part", part).repartition(3, "part").drop("part").write.parquet(at + "/inbox")
    stream = spark.readStream.schema(inbox.schema).option("maxFilesPerTrigger", 1).parquet(at + "/inbox")
    return apply_changes(drained(gap_ordered_changes(stream)))

