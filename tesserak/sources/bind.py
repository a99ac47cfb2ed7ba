"""Views of the model over the star-schema tables.

Every view is a plain projection or aggregate, so filters and column lists of a
query reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking

#: Layers by doc_id modulo 5, and trust tiers from least to most.
LAYERS = ["COMPILED", "SOURCE", "PROJECT", "CONTEXT_PACK", "RESOURCE"]
TRUST = ["UNVERIFIED", "MACHINE_SUPPORTED", "HUMAN_REVIEWED", "ATTESTED"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """Documents by what their own row tells: identity, place, freshness, layer and text,
    with its title and digest.  Of rows (doc_id) ``among``, if they are given.

    What is derived from a text is derived here, before any join, so a join moves texts
    only where a query reads them.
    """
    docs = table(spark, sf_dir, "documents")
    if among is not None:
        docs = docs.join(among.select("doc_id"), "doc_id", "left_semi")
    return docs.select(
        "doc_id",
        F.col("source").alias("vault"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.array(F.concat_ws("-", "source", F.col("doc_id").cast("string")), F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("X"))).alias("aliases"),
        text.first_line(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        F.sha2("text", 256).alias("digest"),
        F.when(F.col("doc_id") % 23 == 0, "STALE_BLOCKED").when(F.col("doc_id") % 17 == 0, "STALE_PENDING_REVIEW").otherwise("FRESH").alias("freshness"),
        F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("layer"),
    )


def documents(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """Governed documents: what identified() gives, with trust and lifecycle by label."""
    trust = F.when(F.col("quality") == 1, "HUMAN_REVIEWED").when(F.col("quality") == 0, "MACHINE_SUPPORTED").otherwise("UNVERIFIED")
    rows = identified(spark, sf_dir, among)
    held = rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return held.select(*rows.columns, trust.alias("trust"), F.when(F.col("toxic") == 1, "DISPUTED").otherwise("ACTIVE").alias("lifecycle"))


def structural(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """The structural units of documents, whose first line is their title; of rows (doc_id)
    ``among``, if they are given."""
    t = table(spark, sf_dir, "documents")
    if among is not None:
        t = t.join(among.select("doc_id"), "doc_id", "left_semi")
    return chunking.structural_units(t.select("doc_id", text.first_line(F.col("text")).alias("title"), F.col("text").alias("body")))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per line that isn't blank: (doc_id, position, content, hash, tokens)."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content"))
    return lines.where(F.trim("content") != "").select("doc_id", F.col("position").cast("long").alias("position"), "content", F.sha2("content", 256).alias("hash"), text.token_estimate(F.col("content")).alias("tokens"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed weighted edges between regions, nations, suppliers and customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    parts = [
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(node("N", "n_nationkey").alias("from_id"), node("R", "r_regionkey").alias("to_id"), F.lit("related_to").alias("relation"), F.lit(1.0).alias("weight")),
        supplier.select(node("S", "s_suppkey").alias("from_id"), node("N", "s_nationkey").alias("to_id"), F.lit("derives_from").alias("relation"), (1.0 / (1 + F.col("s_suppkey") % 4)).alias("weight")),
        customer.select(node("N", "c_nationkey").alias("from_id"), node("C", "c_custkey").alias("to_id"), F.lit("supports").alias("relation"), (1.0 / (1 + F.col("c_custkey") % 5)).alias("weight")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): what edges() are between, with or without an edge."""
    keys = {"R": ("region", "r_regionkey"), "N": ("nation", "n_nationkey"), "S": ("supplier", "s_suppkey"), "C": ("customer", "c_custkey")}
    out = None
    for kind, (name, key) in keys.items():
        part = table(spark, sf_dir, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("node"))
        out = part if out is None else out.unionByName(part)
    return out


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bi-temporal facts: valid for one day from ``ts``; recorded at ``ts``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("fact_id"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.col("value").alias("object"),
        F.col("ts").alias("valid_from"),
        (F.col("ts") + F.expr("interval 1 day")).alias("valid_to"),
        F.col("ts").alias("recorded_at"),
        (F.col("event_id") % 13 == 0).alias("withdrawn"),
    )


def supersessions(facts_df: DataFrame) -> DataFrame:
    """(old_id, new_id): each fact is replaced by the next of its subject and predicate."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    return facts_df.select(F.col("fact_id").alias("old_id"), F.lead("fact_id").over(w).alias("new_id")).where("new_id is not null")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox: one delivery per event, with a causal parent (the user's event before)."""
    e = table(spark, sf_dir, "events")
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.element_at(F.array(*map(F.lit, ["PENDING", "SUCCEEDED", "RETRY", "SUCCEEDED", "CLAIMED", "SUCCEEDED", "QUARANTINED"])), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", (F.col("user_id") % 3).alias("consumer"), "user_id", "ts", parent.alias("parent_id"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 900).cast("decimal(18,6)"))).alias("next_at"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector inbox: numbered events per user; every 29th event never arrived."""
    e = table(spark, sf_dir, "events")
    numbered = e.withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    kind = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT")
    return numbered.where("event_id % 29 <> 0").select(F.col("user_id").alias("connector"), "sequence", "event_id", F.concat(F.lit("o"), (F.col("event_id") % 7).cast("string")).alias("object"), kind.alias("change"), "value")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, target): the href targets of each page."""
    p = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select("page_id", "url", F.explode(F.array_distinct(found)).alias("target"))
