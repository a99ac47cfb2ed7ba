"""Helpers that several operators use: shared storage, salting, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that is
    unset (a local session, as in tests) a temporary folder is chosen, once per
    session; a session on a cluster is refused, as its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tesserak-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage behind it, so a lost executor costs a re-read and
    not a recomputation, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserak-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run within hands Python at most ``rows`` rows at a time.  A batch of texts
    stands in memory several times, in the JVM and in Python, for each core."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if 0 < int(was) <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component).

    ``component`` is the smallest node that can be reached.  Each round hands the
    smallest label of a neighbourhood to its members and then follows the label
    of the label, so the number of rounds is about the logarithm of a
    component's diameter.  Both steps are joins and min() aggregates, which
    combine on the map side; a hub's edges are split by adaptive skew joins
    because every round starts from written tables.  No edges: no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        met = cut(met.join(roots, "low").select("node", "was", F.least("low", "lower").alias("component")), "labels")
        labels = met.select("node", "component")
        if met.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components are not found after {rounds} rounds")


def in_bounded_groups(df: DataFrame, key: str, salt_of: str, most: int) -> DataFrame:
    """Add ``part`` and ``parts`` so that each (key, part) holds about ``most`` rows.

    Keys with more than ``most`` rows are counted (partial sums on the map side)
    and their rows dealt out by a hash of ``salt_of``.  Every row is kept.
    """
    big = cut(df.groupBy(key).agg(F.count("*").alias("held")).where(F.col("held") > most), "big")
    n = F.coalesce(F.ceil(F.col("held") / F.lit(most)), F.lit(1)).cast("int")
    return df.join(big, key, "left").withColumn("parts", n).withColumn("part", F.pmod(F.xxhash64(salt_of), F.col("parts")).cast("int")).drop("held")


def part_pairs(df: DataFrame) -> DataFrame:
    """Copy each row to every pair of parts that its part belongs to.

    Adds ``left`` and ``right`` (left <= right): the group (key, left, right) then
    holds at most two parts, and each two rows of a key meet in exactly one group
    as members of the two sides.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return df.select("*", other).withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other")).drop("other")


def numbered(rows: DataFrame, scope: str, order: list[str], name: str, total: str = "of") -> DataFrame:
    """Add ``name``, each row's place from 0 within its ``scope``, and ``total``, the
    scope's number of rows.

    ``rows`` is best a written table, as it is counted and sampled first.  A range
    sort deals a scope of any size to tasks; a row's place is its running number in
    its task, moved by what the scope has in tasks before.  Rows that are equal in
    ``order`` (nulls first) are dealt out by the partition they come from.
    """
    n, usual = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(usual, -(-n // 4096)), -(-n // 2_000_000), 1)
    by = [scope, *order, "_origin"]
    placed = rows.withColumn("_origin", F.spark_partition_id()).repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    placed = cut(placed.drop("_origin").withColumn("_task", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id()), "sorted")
    held = placed.groupBy(scope, "_task").agg(F.min("_no").alias("_first"), F.count("*").alias("_held"))
    whole = Window.partitionBy(scope)
    before = F.coalesce(F.sum("_held").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = held.select(scope, "_task", (before - F.col("_first")).alias("_move"), F.sum("_held").over(whole).alias(total))
    return placed.join(moves, [scope, "_task"]).withColumn(name, F.col("_no") + F.col("_move")).drop("_task", "_no", "_move")
