"""A positional index that follows a stream of document versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import Segmented
from ..sources import bind


def followed(stream: DataFrame, index: Segmented, checkpoint: str) -> Segmented:
    """Index what is there of a stream (doc_id, version, deleted, external_id, aliases,
    title, path, body), a segment for each batch.

    A batch's number names its segment, so a batch that runs again after a failure
    replaces what it wrote before.
    """
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: index.add(number, batch)).trigger(availableNow=True).start()
    query.awaitTermination()
    return index


def index_of_versions(spark: SparkSession, sf_dir: str, at: str) -> Segmented:
    """An index in folder ``at`` over documents that came in three parts: old versions with the text of
    another order, all documents, and late copies of old versions with deletions of
    documents that were never there."""
    docs = bind.identified(spark, sf_dir).select("doc_id", "external_id", "aliases", "title", "path", "body")
    stamp = lambda version, deleted: [F.lit(version).cast("long").alias("version"), F.lit(deleted).alias("deleted")]
    old = docs.where("doc_id % 3 = 0").select("doc_id", *stamp(1, False), "external_id", "aliases", F.lit("old title").alias("title"), "path", F.reverse("body").alias("body"))
    gone = docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), *stamp(1, False), "external_id", "aliases", "title", "path", "body")
    parts = [old.unionByName(gone), docs.select("doc_id", *stamp(2, False), "external_id", "aliases", "title", "path", "body"), old.unionByName(gone.withColumns({"version": F.lit(3).cast("long"), "deleted": F.lit(True)}))]
    for i, rows in enumerate(parts):
        rows.write.parquet(f"{at}/versions/part={i}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", max(1, spark.read.parquet(f"{at}/versions").select(F.input_file_name()).distinct().count() // 3)).parquet(f"{at}/versions/part=*")
    return followed(stream, Segmented(f"{at}/index", 16), f"{at}/state")
