"""Streams: order over gaps and replays, an index that follows versions."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tesserak.operators import lexical
from tesserak.streaming import events, indexing

INBOX = "connector long, sequence long, object string, change string, value double"


def test_events_wait_until_the_gap_closes(spark):
    at = events.own_dir(spark)
    batches = [
        [(1, 3, "c", "UPSERT", 3.0), (1, 1, "a", "UPSERT", None), (2, 2, "z", "DELETE", 1.0), (3, 5, "q", "UPSERT", 1.0)],
        [(1, 4, "d", "UPSERT", 4.0), (1, 3, "late", "UPSERT", 9.0), (1, 1, "again", "UPSERT", 9.0), (2, 4, "x", "UPSERT", 2.0)],
        [(1, 2, "b", None, 2.0), (1, 3, "c", "UPSERT", 3.0), (2, 1, "y", "UPSERT", 0.5), (3, 4, "p", "UPSERT", 1.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, INBOX).coalesce(1).write.mode("append").parquet(f"{at}/inbox")
        stream = spark.readStream.schema(INBOX).parquet(f"{at}/inbox")
        query = events.gap_ordered_changes(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted((r.connector, r.sequence, r.object, r.value) for r in spark.read.schema(INBOX).parquet(f"{at}/out").collect())
        if i == 0:
            assert got == [(1, 1, "a", None)]
    # the state outlived three runs; what came first counts, and a gap holds back what follows it
    assert got == [(1, 1, "a", None), (1, 2, "b", 2.0), (1, 3, "c", 3.0), (1, 4, "d", 4.0), (2, 1, "y", 0.5), (2, 2, "z", 1.0)]


class Held:
    """A state, value or map, that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _do(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self._do(bool(self.held))

    def get(self):
        return self._do(self.held.get(0))

    def update(self, value):
        self._do(self.held.update({0: value}))

    def containsKey(self, key):
        return self._do(key in self.held)

    def getValue(self, key):
        return self._do(self.held.get(key))

    def updateValue(self, key, value):
        self._do(self.held.update({key: value}))

    def removeKey(self, key):
        self._do(self.held.pop(key))


def test_waiting_events_share_state_entries():
    processor = events.GapOrdered()
    processor.applied, processor.waiting = Held(), Held()
    run = lambda numbers: [(r.sequence, r.value) for r in processor.handleInputRows((1,), iter([Row(sequence=n, object="o", change="UPSERT", value=v) for n, v in numbers]), None)]
    n = 25_000  # more than are held at once
    late = [(k, float(k)) for k in range(n, 1, -1)]
    assert run(late) == [] and len(processor.waiting.held) <= n // events.CHUNK + 1
    assert run([(2, -1.0), (n, -1.0), (7, -1.0)]) == []  # what came first counts
    assert processor.waiting.calls + processor.applied.calls < n / 10
    assert run([(1, 1.0), (3, -1.0)]) == [(k, float(k)) for k in range(1, n + 1)]
    assert not processor.waiting.held and processor.applied.held == {0: (n,)}


def versions(spark, rows):
    return spark.createDataFrame([(i, v, gone, f"X-{i}", ["al"], title, f"p/{i}", body) for i, v, gone, title, body in rows], "doc_id long, version long, deleted boolean, external_id string, aliases array<string>, title string, path string, body string")


def test_an_index_follows_versions_and_replays(spark):
    at = events.own_dir(spark)
    index = lexical.Segmented(f"{at}/index", 4)
    parts = [[(1, 1, False, "old", "alpha"), (2, 1, False, "t", "alpha beta"), (3, 1, False, "t", "gamma")], [(1, 3, False, "new", "delta"), (2, 2, True, "t", "alpha beta"), (2, 1, False, "t", "zeta")], [(1, 2, False, "late", "alpha"), (3, 2, False, "t", "gamma gamma"), (3, 2, False, "t", "gamma gamma")]]
    for rows in parts:
        versions(spark, rows).coalesce(1).write.mode("append").parquet(f"{at}/versions")
        stream = spark.readStream.schema(versions(spark, []).schema).parquet(f"{at}/versions")
        indexing.followed(stream, index, f"{at}/state")
    asked = spark.createDataFrame(list(enumerate(["alpha", "delta", "gamma", "beta", "zeta", "new"])), "query_id long, query string")
    every = spark.range(10).select(F.col("id").alias("doc_id"))

    def found():
        return sorted((r.query_id, r.doc_id, r.raw_score, r.reason, r.unit) for r in lexical.search(index, asked, every, 10).collect())

    first = found()
    assert [(q, d) for q, d, *_ in first] == [(1, 1), (2, 3), (5, 1)]
    index.add(1, versions(spark, parts[1]))  # a batch that runs again replaces its segment
    assert found() == first
    whole = lexical.Index(f"{at}/whole", 4)
    last = versions(spark, [(1, 3, False, "new", "delta"), (3, 2, False, "t", "gamma gamma")])
    from tesserak.operators.chunking import structural_units

    whole.write(last, structural_units(last.select("doc_id", "title", "body")))
    assert sorted((r.query_id, r.doc_id, r.raw_score, r.reason, r.unit) for r in lexical.search(whole, asked, every, 10).collect()) == first
