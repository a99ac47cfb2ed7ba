"""Truth maintenance, boundary detectors and queue upkeep over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as op
from ..sources import bind
from .relational import DELIVERIES

CUT = "timestamp_ntz'2024-01-10 00:00:00'"
LATER = "timestamp_ntz'2024-01-11 00:00:00'"


def _sources(spark, d):
    f = bind.facts(spark, d).withColumn("source", F.col("subject") % 40)
    gone = f.where("fact_id % 31 = 0 and source % 3 = 0").select("source", F.col("recorded_at").alias("at"))
    return f, gone


def withdraw_source(spark, d):
    f, gone = _sources(spark, d)
    return op.withdrawn_facts(f, gone, F.expr(CUT))


def invalidate_evidence(spark, d):
    """Per predicate, how many facts lose their source by two instants."""
    f, gone = _sources(spark, d)
    out = f.groupBy("predicate").agg(F.count("*").alias("facts"))
    for name, at in (("early", CUT), ("late", LATER)):
        lost = op.withdrawn_facts(f, gone, F.expr(at)).join(f.select("fact_id", "predicate"), "fact_id").groupBy("predicate").agg(F.count("*").alias(name))
        out = out.join(lost, "predicate", "left")
    return out.select("predicate", "facts", F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("late", F.lit(0)).alias("late"))


def support_history(spark, d):
    e = bind.table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "UNSUPPORTED").when(F.col("value") > 100, "DISPUTED").otherwise("SUPPORTED")
    return op.state_history(e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state")), ["user_id"])


def _snapshot(spark, d, at):
    f = bind.facts(spark, d).withColumn("scope", F.col("subject") % 60)
    return op.snapshot(f, "scope", F.expr(at))


def snapshot_capture(spark, d):
    return _snapshot(spark, d, CUT).select("scope", "n")


def snapshot_unchanged(spark, d):
    return op.unchanged(_snapshot(spark, d, CUT), _snapshot(spark, d, LATER), "scope")


def dependency_register(spark, d):
    """What each derived item (a user) depends on: distinct kinds with first and last use."""
    e = bind.table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("uses"))


def derived_rebuild(spark, d):
    e = bind.table(spark, d, "events")
    items = e.groupBy(F.col("user_id").alias("item_id")).agg(F.expr("min_by(ts, event_id)").alias("built_at")).where("item_id % 2 = 0")
    return op.to_rebuild(items, e.where("event_type = 'purchase'").select(F.col("user_id").alias("item_id"), F.col("ts").alias("at")))


def derived_cleanup(spark, d):
    """Derived items (a user's day) without any supported dependency left (an event that
    is no error): what a cleanup removes, and how many dependencies it had."""
    e = bind.table(spark, d, "events")
    n = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("good"), F.count("*").alias("bad"))
    return n.where("good = 0").select("user_id", "day", "bad")


def code_graph_freshness(spark, d):
    s, o = bind.table(spark, d, "supplier"), bind.table(spark, d, "orders")
    k = F.col("s_suppkey")
    projects = s.select(k.alias("project_id"), F.concat(F.lit("c"), k.cast("string")).alias("commit"), F.when(k % 13 == 0, "FAILED").when(k % 17 == 0, "DEGRADED").otherwise("REQUESTED").alias("code_status"))
    project = F.col("o_custkey") % 101
    rows = o.select(
        project.alias("project_id"),
        F.col("o_orderkey").alias("projection_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "RUNTIME").otherwise("CODE").alias("domain"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RETIRED").alias("lifecycle"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "STALE").otherwise("FRESH").alias("freshness"),
        F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise(F.concat(F.lit("c"), project.cast("string"))).alias("revision"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return op.code_graph_freshness(projects, rows)


def access_boundary(spark, d):
    o = bind.table(spark, d, "orders")
    space, vault = F.col("o_custkey") % 4, F.col("o_custkey") % 20
    other = (F.col("o_custkey") * 3 + 1) % 23
    packets = o.where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("packet_id"),
        space.alias("space"),
        vault.alias("vault"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(9)).when(F.col("o_orderkey") % 11 != 0, space).alias("scope_space"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array(vault, other)).when(F.col("o_orderkey") % 8 == 0, F.array(other)).when(F.col("o_orderkey") % 10 != 3, F.array(vault)).alias("scope_vaults"),
        (F.col("o_orderkey") % 15 == 0).alias("federated"),
    )
    vaults = spark.range(20).select(F.col("id").alias("vault"), (F.col("id") % 4).alias("space"))
    return op.access_boundary(packets, vaults)


def connector_acl_drift(spark, d):
    c, n = bind.table(spark, d, "customer"), bind.table(spark, d, "nation")
    names = lambda k: F.element_at(F.array(*map(F.lit, ["FULL", "PARTIAL", "NONE"])), (k % 3 + 1).cast("int"))
    objects = c.select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("connector_id"), names(F.col("c_custkey")).alias("fidelity"), (F.col("c_custkey") % 17 == 0).alias("uncertain"), F.when(F.col("c_mktsegment") == "BUILDING", "DELETED").otherwise("ACTIVE").alias("lifecycle"))
    connectors = n.select(F.col("n_nationkey").alias("connector_id"), F.when(F.col("n_nationkey") % 5 != 0, names(F.col("n_nationkey"))).alias("declared"), F.when(F.col("n_nationkey") % 7 == 0, "PAUSED").otherwise("ACTIVE").alias("state"))
    return op.acl_drift(objects, connectors)


def unsupported_causality(spark, d):
    e = bind.table(spark, d, "events")
    derivation = F.element_at(F.array(*map(F.lit, ["SOURCE_EXPLICIT", "HUMAN_ASSERTED", "DYNAMICALLY_PROVEN", "INFERRED", "STATIC"])), (F.col("event_id") % 5 + 1).cast("int"))
    return op.unsupported_causality(e.select(F.col("event_id").alias("activity_id"), F.when(F.col("event_type") == "error", "CAUSED").otherwise("SEEN").alias("action"), derivation.alias("derivation")))


def inbox_summary(spark, d):
    return op.inbox_summary(bind.inbox(spark, d))


def stale_event_suppression(spark, d):
    rows = bind.inbox(spark, d).select("connector", "object", "sequence", (F.col("sequence") + F.when(F.col("event_id") % 6 == 0, 9).otherwise(0) + F.col("event_id") / F.lit(1e9)).alias("arrival"))
    return op.stale_suppressed(rows)


def requeue(spark, d):
    return op.requeued(bind.deliveries(spark, d), 1)


def consumer_backfill(spark, d):
    own = bind.deliveries(spark, d).where("event_id % 4 <> 0")
    return op.backfill(bind.table(spark, d, "events").where("event_type <> 'view'"), own, 2)


QUERIES = {f.__name__: f for f in (withdraw_source, invalidate_evidence, support_history, snapshot_capture, snapshot_unchanged, dependency_register, derived_rebuild, derived_cleanup, code_graph_freshness, access_boundary, connector_acl_drift, unsupported_causality, inbox_summary, stale_event_suppression, requeue, consumer_backfill)}

_C, _L = "timestamp '2024-01-10 00:00:00'", "timestamp '2024-01-11 00:00:00'"
GONE = "gone as (select user_id % 40 as source, ts from events where event_id % 31 = 0 and user_id % 40 % 3 = 0)"
_INBOX = "inbox as (select user_id as connector, sequence, event_id, 'o' || (event_id % 7) as object from (select *, row_number() over (partition by user_id order by ts, event_id) as sequence from events) where event_id % 29 <> 0)"

SQL = {
    "withdraw_source": f"with {GONE}, w as (select source, min(ts) as withdrawn_at from gone where ts <= {_C} group by 1) select event_id as fact_id, source, withdrawn_at from events join w on source = user_id % 40",
    "invalidate_evidence": f"""with {GONE}, w as (select source, min(ts) as lost from gone group by 1) select event_type as predicate, count(*) as facts, count(*) filter (lost <= {_C}) as early, count(*) filter (lost <= {_L}) as late from events left join w on source = user_id % 40 group by 1""",
    "support_history": """with s as (select user_id, ts, event_id, case when event_type = 'error' then 'UNSUPPORTED' when value > 100 then 'DISPUTED' else 'SUPPORTED' end as state from events), l as (select *, lag(state) over (partition by user_id order by ts, event_id) as was from s), c as (select * from l where was is null or was <> state)
      select user_id, ts as "at", event_id as seq, was, state, cast(floor(epoch(lead(ts) over (partition by user_id order by ts, event_id))) - floor(epoch(ts)) as bigint) as seconds from c""",
    "snapshot_capture": f"select user_id % 60 as scope, count(*) as n from events where ts <= {_C} group by 1",
    "snapshot_unchanged": f"""with s as (select user_id % 60 as scope, count(*) filter (ts <= {_C}) as was, count(*) filter (ts <= {_L}) as now from events group by 1) select scope, was, now, was = now as unchanged from s where now > 0""",
    "dependency_register": "select user_id, event_type, min(event_id) as first_event, max(event_id) as last_event, count(*) as uses from events group by 1, 2",
    "derived_rebuild": """with i as (select user_id as item_id, arg_min(ts, event_id) as built_at from events where user_id % 2 = 0 group by 1) select item_id, built_at, count(*) as changes, max(ts) as last_change from events join i on item_id = user_id where event_type = 'purchase' and ts > built_at group by 1, 2""",
    "derived_cleanup": "select user_id, cast(ts as date) as day, count(*) as bad from events group by 1, 2 having count(*) filter (event_type <> 'error') = 0",
    "code_graph_freshness": """with p as (select s_suppkey as project_id, 'c' || s_suppkey as commit, case when s_suppkey % 13 = 0 then 'FAILED' when s_suppkey % 17 = 0 then 'DEGRADED' else 'REQUESTED' end as status from supplier),
      g as (select o_custkey % 101 as project_id, o_orderkey as id, case when o_orderkey % 3 = 0 then 'RUNTIME' else 'CODE' end as domain, case o_orderstatus when 'O' then 'ACTIVE' when 'P' then 'FAILED' else 'RETIRED' end as life, case when starts_with(o_orderpriority, '1') then 'STALE' else 'FRESH' end as fresh,
        case when o_orderkey % 4 = 0 then 'old' else 'c' || (o_custkey % 101) end as rev, o_orderdate as t from orders),
      a as (select * from (select *, row_number() over (partition by project_id order by t desc, id desc) as n from g where domain = 'CODE' and life = 'ACTIVE') where n = 1),
      l as (select * from (select *, row_number() over (partition by project_id order by t desc, id desc) as n from g where domain = 'CODE') where n = 1),
      r as (select * from (select *, row_number() over (partition by project_id order by life = 'ACTIVE' desc, t desc, id desc) as n from g where domain = 'RUNTIME') where n = 1)
      select p.project_id, 'STALE_RUNTIME_EVIDENCE' as finding, case when r.life = 'FAILED' then 'CRITICAL' else 'HIGH' end as severity from p join r using (project_id) where r.life <> 'ACTIVE' or r.fresh <> 'FRESH' or r.rev <> commit
      union all select project_id, f, case f when 'CODE_GRAPH_MISSING' then 'HIGH' when 'CODE_GRAPH_STALE' then 'HIGH' else 'CRITICAL' end from (select p.project_id, case when status in ('FAILED', 'DEGRADED') or coalesce(l.life = 'FAILED', false) then 'CODE_GRAPH_EXTRACTOR_FAILED' when a.id is null then 'CODE_GRAPH_MISSING' when a.rev <> commit then 'CODE_GRAPH_REPO_SHA_MISMATCH' when a.fresh <> 'FRESH' then 'CODE_GRAPH_STALE' end as f
        from p left join a using (project_id) left join l using (project_id)) where f is not null""",
    "access_boundary": """with p as (select o_orderkey as packet_id, o_custkey % 4 as space, o_custkey % 20 as vault, (o_custkey * 3 + 1) % 23 as other, o_orderkey as k from orders where o_orderkey % 3 = 0),
      q as (select *, case when k % 7 = 0 then 9 when k % 11 <> 0 then space end as ss, case when k % 5 = 0 then [vault, other] when k % 8 = 0 then [other] when k % 10 <> 3 then [vault] end as sv, k % 15 = 0 as fed from p)
      select packet_id, 'SCOPE_SPACE' as finding from q where ss is distinct from space union all select packet_id, 'VAULT_NOT_DECLARED' from q where sv is null or not list_contains(sv, vault) union all select packet_id, 'NOT_FEDERATED' from q where len(sv) > 1 and not fed
      union all select distinct packet_id, 'FOREIGN_VAULT' from (select packet_id, space, unnest(sv) as v from q) where v >= 20 or v % 4 <> space""",
    "connector_acl_drift": """with c as (select c_custkey as object_id, ['FULL', 'PARTIAL', 'NONE'][c_custkey % 3 + 1] as f, c_custkey % 17 = 0 as u, case when c_nationkey % 5 <> 0 then ['FULL', 'PARTIAL', 'NONE'][c_nationkey % 3 + 1] end as d from customer where c_mktsegment <> 'BUILDING' and c_nationkey % 7 <> 0)
      select object_id, case when u then 'CONNECTOR_ACL_UNCERTAIN' else 'CONNECTOR_ACL_FIDELITY_DRIFT' end as finding, case when u then 'HIGH' else 'MEDIUM' end as severity from c where u or (d is not null and f <> d)""",
    "unsupported_causality": "select event_id as activity_id, case event_id % 5 when 3 then 'INFERRED' else 'STATIC' end as derivation from events where event_type = 'error' and event_id % 5 in (3, 4)",
    "inbox_summary": f"""with {_INBOX}, n as (select connector, sequence, row_number() over (partition by connector order by sequence) as n from inbox) select connector, count(*) as n, max(sequence) as last, min(case when sequence <> n then n end) as next_gap, count(*) filter (sequence <> n) as blocked from n group by 1""",
    "stale_event_suppression": f"""with {_INBOX}, a as (select *, max(sequence) over (partition by connector, object order by sequence + case when event_id % 6 = 0 then 9 else 0 end + event_id / 1e9 rows between unbounded preceding and 1 preceding) as m from inbox)
      select connector, count(*) filter (not coalesce(m > sequence, false)) as applied, count(*) filter (coalesce(m > sequence, false)) as suppressed from a group by 1""",
    "requeue": f"with {DELIVERIES} select event_id, 'PENDING' as status, 0 as attempts from deliveries where status = 'QUARANTINED' and consumer = 1",
    "consumer_backfill": "select event_id, 2 as consumer from events where event_type <> 'view' and (event_id % 4 = 0 or user_id % 3 <> 2)",
}
