"""Detectors and lifecycles over projections, findings, handoffs, claims and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graph_disagreement(projections: DataFrame) -> DataFrame:
    """(scope, n_active): scopes with more than one ACTIVE revision."""
    return projections.groupBy("scope").agg(F.count_if(F.col("status") == "ACTIVE").alias("n_active")).where("n_active > 1")


def retire_older(projections: DataFrame) -> DataFrame:
    """(scope, revision, status): of ACTIVE revisions the newest stays, the rest are RETIRED."""
    rank = F.row_number().over(Window.partitionBy("scope", "status").orderBy(F.desc("at"), F.desc("revision")))
    kept = F.when((F.col("status") == "ACTIVE") & (rank > 1), "RETIRED").otherwise(F.col("status"))
    return projections.select("scope", "revision", kept.alias("status"))


def catalog(projections: DataFrame) -> DataFrame:
    """Per scope: revisions in each state, the latest requested and the latest active."""
    return projections.groupBy("scope").agg(
        F.count("*").alias("revisions"),
        F.count_if(F.col("status") == "STALE").alias("stale"),
        F.count_if(F.col("status") == "BUILDING").alias("building"),
        F.max(F.struct("at", "revision")).getField("revision").alias("latest"),
        F.max(F.when(F.col("status") == "ACTIVE", F.struct("at", "revision"))).getField("revision").alias("latest_active"),
    )


def missing_tombstones(inbox: DataFrame, applied: DataFrame) -> DataFrame:
    """(connector, object, sequence): objects whose newest change is a deletion that
    was never applied.  ``applied``: (connector, object, deleted)."""
    last = inbox.groupBy("connector", "object").agg(F.max(F.struct("sequence", "change")).alias("l"))
    gone = last.where("l.change = 'DELETE'").select("connector", "object", F.col("l.sequence").alias("sequence"))
    return gone.join(applied.where("deleted").select("connector", "object"), ["connector", "object"], "left_anti")


def stale_handoffs(turns: DataFrame, handoffs: DataFrame) -> DataFrame:
    """(conv_id, turn): handoffs whose pinned hash isn't that of the latest turn."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "hash")).alias("l"))
    met = handoffs.join(last, "conv_id")
    return met.where(F.col("l.hash") != F.col("pinned")).select("conv_id", F.col("l.turn").alias("turn"))


def finding_lifecycle(findings: DataFrame, quiet_days: int) -> DataFrame:
    """(finding_key, first_seen, last_seen, n, reopened): sightings of a stable key; a
    finding reopens after ``quiet_days`` without one."""
    key = F.sha2(F.concat_ws("|", "detector", F.col("subject").cast("string")), 256)
    rows = findings.withColumn("finding_key", key)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("finding_key").orderBy("at"))
    rows = rows.withColumn("again", F.coalesce(gap > F.expr(f"interval {quiet_days} days"), F.lit(False)))
    return rows.groupBy("finding_key").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n"), F.count_if("again").alias("reopened"))


def contradiction_clusters(facts: DataFrame) -> DataFrame:
    """(subject, predicate, n_facts, n_objects, first_fact): facts of one subject and
    predicate that differ."""
    found = facts.groupBy("subject", "predicate").agg(F.count("*").alias("n_facts"), F.count_distinct("object").alias("n_objects"), F.min("fact_id").alias("first_fact"))
    return found.where("n_objects > 1")


def claim_overlaps(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """(prefix, n_paths): paths equal to a claimed prefix or under it.

    Each path lists its own prefixes, so the overlap is an equi join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = paths.select(F.explode(prefixes).alias("prefix"))
    return own.join(claims, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("n_paths"))


def incremental_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(unit_id, change): ADDED, REMOVED, CHANGED or UNCHANGED by content hash."""
    a, b = old.select("unit_id", F.col("hash").alias("was")), new.select("unit_id", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, "unit_id", "full_outer").select("unit_id", change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored and incoming rows, the highest version of each key; tombstones stay."""
    rows = stored.unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), version)
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def transitions(events: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(from_state, to_state, n, allowed): steps between states of each subject."""
    before = F.lag("state").over(Window.partitionBy("subject").orderBy("at", "id"))
    rows = events.select(before.alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null")
    ok = F.lit(False)
    for a, targets in allowed.items():
        ok = ok | ((F.col("from_state") == a) & F.col("to_state").isin(targets))
    return rows.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).withColumn("allowed", ok)


def identity_check(exact: DataFrame, lexical: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, outcome): SAME for one document of the exact channel, UNRESOLVED for
    more, POSSIBLE_DUPLICATE for lexical hits only, else DISTINCT."""
    e = exact.groupBy("query_id").agg(F.count_distinct("doc_id").alias("e"))
    x = lexical.groupBy("query_id").agg(F.count_distinct("doc_id").alias("x"))
    met = queries.join(e, "query_id", "left").join(x, "query_id", "left")
    outcome = F.when(F.col("e") == 1, "SAME").when(F.col("e") > 1, "UNRESOLVED").when(F.col("x") > 0, "POSSIBLE_DUPLICATE").otherwise("DISTINCT")
    return met.select("query_id", outcome.alias("outcome"))


def community_search(members: DataFrame, exact: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, community, score): 100 if a seed is a member, 10 per query that its
    text meets, and the logarithm of its size.  ``members``: (community, doc_id)."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    hits = exact.select("query_id", "doc_id", F.lit(1).alias("seed"), F.lit(0).alias("words")).unionByName(lexical.select("query_id", "doc_id", F.lit(0).alias("seed"), F.lit(1).alias("words")))
    met = hits.join(members, "doc_id").groupBy("query_id", "community").agg(F.max("seed").alias("seed"), F.max("words").alias("words"))
    return met.join(sizes, "community").select("query_id", "community", F.round(100.0 * F.col("seed") + 10.0 * F.col("words") + F.ln(F.col("n") + 1.0), 6).alias("score"))
