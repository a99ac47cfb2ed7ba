"""Truth maintenance, boundary detectors and queue upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def withdrawn_facts(facts: DataFrame, withdrawn: DataFrame, at: Column) -> DataFrame:
    """(fact_id, source, withdrawn_at) of facts whose source is withdrawn by an instant;
    the first withdrawal of a source counts.  ``withdrawn``: (source, at)."""
    first = withdrawn.where(F.col("at") <= at).groupBy("source").agg(F.min("at").alias("withdrawn_at"))
    return facts.select("fact_id", "source").join(first, "source")


def state_history(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, at, seq, state) at which a key's state changes, with the state before
    and how long the new one lasts in seconds (null: until now)."""
    w = Window.partitionBy(*keys).orderBy("at", "seq")
    was = F.lag("state").over(w)
    changes = rows.withColumn("was", was).where("was is null or was <> state")
    seconds = F.unix_timestamp(F.lead("at").over(w).cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))
    return changes.select(*keys, "at", "seq", "was", "state", seconds.alias("seconds"))


def snapshot(facts: DataFrame, scope: str, cutoff: Column) -> DataFrame:
    """(scope, n, digest): the facts of a scope recorded by a cutoff.

    The digest is a sum of 64-bit hashes, taken as decimals, so it combines before
    the shuffle and doesn't gather a scope's facts in one row.
    """
    known = facts.where(F.col("recorded_at") <= cutoff)
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("fact_id", "subject", "predicate")]), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return known.groupBy(scope).agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").cast("string").alias("digest"))


def unchanged(before: DataFrame, after: DataFrame, scope: str) -> DataFrame:
    """(scope, was, now, unchanged) of two snapshots."""
    a = before.select(scope, F.col("n").alias("was"), F.col("digest").alias("d1"))
    b = after.select(scope, F.col("n").alias("now"), F.col("digest").alias("d2"))
    met = a.join(b, scope, "full_outer")
    return met.select(scope, F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"), F.col("d1").eqNullSafe(F.col("d2")).alias("unchanged"))


def to_rebuild(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(item_id, built_at, changes, last_change) of items with a dependency that changed
    after they were built.  ``items``: (item_id, built_at); ``dependencies``: (item_id, at)."""
    met = dependencies.join(items, "item_id").where(F.col("at") > F.col("built_at"))
    return met.groupBy("item_id", "built_at").agg(F.count("*").alias("changes"), F.max("at").alias("last_change"))


def code_graph_freshness(projects: DataFrame, projections: DataFrame) -> DataFrame:
    """(project_id, finding, severity): what is wrong with a project's code graph.

    ``projects``: (project_id, commit, code_status); ``projections``: (project_id,
    projection_id, domain, lifecycle, freshness, revision, updated_at).  The newest
    active, the newest and the best runtime projection of a project come from one
    aggregate.  Runtime evidence is judged apart; of the others the first holds.
    """
    newest = F.struct("updated_at", "projection_id", "lifecycle", "freshness", "revision")
    code, active = F.col("domain") == "CODE", F.col("lifecycle") == "ACTIVE"
    best = projections.groupBy("project_id").agg(
        F.max(F.when(code & active, newest)).alias("active"),
        F.max(F.when(code, newest)).alias("latest"),
        F.max(F.when(F.col("domain") == "RUNTIME", F.struct(active.alias("is_active"), "updated_at", "projection_id", "lifecycle", "freshness", "revision"))).alias("runtime"),
    )
    rows = projects.join(best, "project_id", "left")
    stale_runtime = F.col("runtime").isNotNull() & ((F.col("runtime.lifecycle") != "ACTIVE") | (F.col("runtime.freshness") != "FRESH") | (F.col("runtime.revision") != F.col("commit")))
    runtime = F.when(stale_runtime, F.struct(F.lit("STALE_RUNTIME_EVIDENCE").alias("finding"), F.when(F.col("runtime.lifecycle") == "FAILED", "CRITICAL").otherwise("HIGH").alias("severity")))
    found = lambda name, severity: F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"))
    graph = (
        F.when(F.col("code_status").isin("FAILED", "DEGRADED") | F.coalesce(F.col("latest.lifecycle") == "FAILED", F.lit(False)), found("CODE_GRAPH_EXTRACTOR_FAILED", "CRITICAL"))
        .when(F.col("active").isNull(), found("CODE_GRAPH_MISSING", "HIGH"))
        .when(F.col("active.revision") != F.col("commit"), found("CODE_GRAPH_REPO_SHA_MISMATCH", "CRITICAL"))
        .when(F.col("active.freshness") != "FRESH", found("CODE_GRAPH_STALE", "HIGH"))
    )
    each = F.explode(F.filter(F.array(runtime, graph), lambda x: x.isNotNull())).alias("f")
    return rows.select("project_id", each).select("project_id", "f.finding", "f.severity")


def access_boundary(packets: DataFrame, vaults: DataFrame) -> DataFrame:
    """(packet_id, finding): packets whose scope crosses a boundary.

    ``packets``: (packet_id, space, vault, scope_space, scope_vaults, federated);
    ``vaults``: (vault, space).  Declared vaults are exploded and joined once.
    """
    own = (
        (~F.col("scope_space").eqNullSafe(F.col("space")), "SCOPE_SPACE"),
        (F.col("scope_vaults").isNull() | ~F.array_contains("scope_vaults", F.col("vault")), "VAULT_NOT_DECLARED"),
        ((F.size("scope_vaults") > 1) & ~F.coalesce("federated", F.lit(False)), "NOT_FEDERATED"),
    )
    each = F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in own]), lambda x: x.isNotNull())).alias("finding")
    declared = packets.select("packet_id", "space", F.explode("scope_vaults").alias("vault")).join(vaults.select("vault", F.col("space").alias("vault_space")), "vault", "left")
    foreign = declared.where("vault_space is null or vault_space <> space").select("packet_id", F.lit("FOREIGN_VAULT").alias("finding")).distinct()
    return packets.select("packet_id", each).unionByName(foreign)


def acl_drift(objects: DataFrame, connectors: DataFrame) -> DataFrame:
    """(object_id, finding, severity) of active objects whose permissions are uncertain
    or of another fidelity than their connector declares."""
    met = objects.where("lifecycle = 'ACTIVE'").join(connectors.where("state = 'ACTIVE'"), "connector_id")
    bad = F.col("uncertain") | (F.col("declared").isNotNull() & (F.col("fidelity") != F.col("declared")))
    name = F.when(F.col("uncertain"), "CONNECTOR_ACL_UNCERTAIN").otherwise("CONNECTOR_ACL_FIDELITY_DRIFT")
    return met.where(bad).select("object_id", name.alias("finding"), F.when(F.col("uncertain"), "HIGH").otherwise("MEDIUM").alias("severity"))


#: Derivations that may support a causal claim.
CAUSAL = ["SOURCE_EXPLICIT", "HUMAN_ASSERTED", "DYNAMICALLY_PROVEN"]


def unsupported_causality(activity: DataFrame) -> DataFrame:
    """(activity_id, derivation) of causal claims that no allowed derivation supports."""
    return activity.where((F.col("action") == "CAUSED") & ~F.col("derivation").isin(CAUSAL)).select("activity_id", "derivation")


def inbox_summary(events: DataFrame) -> DataFrame:
    """(connector, n, last, next_gap, blocked): a connector's events, its last number,
    the first number that is missing below it, and how many wait behind that."""
    w = Window.partitionBy("connector").orderBy("sequence")
    numbered = events.select("connector", "sequence").distinct().withColumn("n", F.row_number().over(w))
    per = numbered.groupBy("connector").agg(F.count("*").alias("n"), F.max("sequence").alias("last"), F.min(F.when(F.col("sequence") != F.col("n"), F.col("n"))).cast("long").alias("next_gap"), F.count_if(F.col("sequence") != F.col("n")).alias("blocked"))
    return per.select("connector", "n", "last", "next_gap", "blocked")


def stale_suppressed(events: DataFrame) -> DataFrame:
    """(connector, applied, suppressed): an event of an object counts as stale if one
    that arrived before it has a higher number.  ``events``: (connector, object, sequence, arrival)."""
    w = Window.partitionBy("connector", "object").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    stale = F.coalesce(F.max("sequence").over(w) > F.col("sequence"), F.lit(False))
    return events.withColumn("stale", stale).groupBy("connector").agg(F.count_if(~F.col("stale")).alias("applied"), F.count_if("stale").alias("suppressed"))


def requeued(deliveries: DataFrame, consumer: int) -> DataFrame:
    """A consumer's quarantined deliveries, as they stand after a requeue."""
    rows = deliveries.where((F.col("status") == "QUARANTINED") & (F.col("consumer") == consumer))
    return rows.select("event_id", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"))


def backfill(events: DataFrame, deliveries: DataFrame, consumer: int) -> DataFrame:
    """(event_id, consumer): events that a newly registered consumer has no delivery of."""
    own = deliveries.where(F.col("consumer") == consumer).select("event_id")
    return events.select("event_id").join(own, "event_id", "left_anti").withColumn("consumer", F.lit(consumer))
