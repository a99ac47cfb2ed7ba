"""Detector and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assurance, ordered
from ..sources import bind
from . import analytics, retrieval

#: Which event may follow which.
ALLOWED = {"signup": ["view", "click"], "view": ["click", "purchase", "view"], "click": ["purchase", "view", "error"], "purchase": ["view"], "error": ["view", "click"]}


def _projections(spark, d):
    o = bind.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "STALE").otherwise("BUILDING")
    return o.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("at"), status.alias("status"))


def graph_disagreement(spark, d):
    return assurance.graph_disagreement(_projections(spark, d))


def retire_older_generations(spark, d):
    return assurance.retire_older(_projections(spark, d))


def graph_catalog(spark, d):
    return assurance.catalog(_projections(spark, d))


def connector_deletion(spark, d):
    inbox = bind.inbox(spark, d)
    return assurance.missing_tombstones(inbox, ordered.apply_changes(ordered.gap_free_prefix(inbox)))


def stale_handoff(spark, d):
    c = bind.table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("hash"))
    pins = c.where("turn = 2").select("conv_id", F.col("hash").alias("pinned"))
    return assurance.stale_handoffs(c, pins)


def finding_lifecycle(spark, d):
    e = bind.table(spark, d, "events")
    return assurance.finding_lifecycle(e.select(F.col("event_type").alias("detector"), F.col("user_id").alias("subject"), F.col("ts").alias("at")), 3)


def contradiction_clusters(spark, d):
    return assurance.contradiction_clusters(bind.facts(spark, d).where(~F.col("withdrawn")))


def claim_overlaps(spark, d):
    docs = bind.documents(spark, d)
    claims = docs.select("vault", F.concat_ws("/", "vault", F.lit("en")).alias("en")).distinct()
    return assurance.claim_overlaps(claims.select(F.explode(F.array("vault", "en")).alias("prefix")).distinct(), docs.select("path"))


def incremental_index(spark, d):
    docs = bind.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.sha2("text", 256).alias("hash"))
    old = docs.select(F.when(F.col("unit_id") % 11 == 0, -F.col("unit_id") - 1).otherwise(F.col("unit_id")).alias("unit_id"), F.when(F.col("unit_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return assurance.incremental_changes(old, docs)


def document_upsert(spark, d):
    p = bind.table(spark, d, "part").select("p_partkey", F.lit(1).alias("version"), "p_retailprice", F.lit(False).alias("deleted"))
    new = p.select((F.col("p_partkey") + 5).alias("p_partkey"), F.lit(2).alias("version"), (F.col("p_retailprice") * 2).alias("p_retailprice"), (F.col("p_partkey") % 9 == 0).alias("deleted"))
    return assurance.upsert(p, new, ["p_partkey"], "version")


def state_transitions(spark, d):
    e = bind.table(spark, d, "events")
    return assurance.transitions(e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("id")), ALLOWED)


def _hit_sets(spark, d):
    return retrieval.exact_lookup(spark, d), retrieval.lexical_search(spark, d)


def identity_check(spark, d):
    exact, lexical = _hit_sets(spark, d)
    return assurance.identity_check(exact, lexical, bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")))


def community_search(spark, d):
    exact, lexical = _hit_sets(spark, d)
    return assurance.community_search(bind.documents(spark, d).select(F.col("vault").alias("community"), "doc_id"), exact, lexical)


def labelled_coverage(spark, d):
    docs = bind.table(spark, d, "documents").select("doc_id", "source").join(bind.table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"))


def raw_layer_search(spark, d):
    """Documents of the raw layers, by trust and then size, the top 5 of each vault."""
    docs = bind.documents(spark, d).where(F.col("layer").isin("SOURCE", "RESOURCE"))
    tier = F.create_map(*[x for i, t in enumerate(bind.TRUST) for x in (F.lit(t), F.lit(i))])[F.col("trust")]
    rows = docs.select("vault", "doc_id", tier.alias("tier"), F.length("body").alias("size"))
    n = F.row_number().over(Window.partitionBy("vault").orderBy(F.desc("tier"), F.desc("size"), "doc_id"))
    return rows.withColumn("place", n.cast("long")).where("place <= 5").select("vault", "doc_id", "place")


QUERIES = {f.__name__: f for f in (graph_disagreement, retire_older_generations, graph_catalog, connector_deletion, stale_handoff, finding_lifecycle, contradiction_clusters, claim_overlaps, incremental_index, document_upsert, state_transitions, identity_check, community_search, labelled_coverage, raw_layer_search)}

_P = "p as (select o_custkey as scope, o_orderkey as revision, o_orderdate as at_, case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'STALE' else 'BUILDING' end as status from orders)"
_HITS = f"{retrieval.GOVERNED}, {retrieval.EXACT}, {retrieval.LEXICAL}"
_OK = " or ".join(f"(f = '{a}' and t in ({', '.join(repr(x) for x in b)}))" for a, b in ALLOWED.items())

SQL = {
    "graph_disagreement": f"with {_P} select scope, count(*) as n_active from p where status = 'ACTIVE' group by 1 having count(*) > 1",
    "retire_older_generations": f"with {_P} select scope, revision, case when status = 'ACTIVE' and row_number() over (partition by scope, status order by at_ desc, revision desc) > 1 then 'RETIRED' else status end as status from p",
    "graph_catalog": f"with {_P} select scope, count(*) as revisions, count(*) filter (status = 'STALE') as stale, count(*) filter (status = 'BUILDING') as building, last(revision order by at_, revision) as latest, last(revision order by at_, revision) filter (status = 'ACTIVE') as latest_active from p group by 1",
    "connector_deletion": f"""with {analytics.INBOX}, l as (select *, row_number() over (partition by connector, object order by sequence desc) as n from inbox),
      f as (select * from (select *, row_number() over (partition by connector order by sequence) as n from inbox) where n = sequence), a as (select *, row_number() over (partition by connector, object order by sequence desc) as k from f)
      select connector, object, sequence from l where n = 1 and change = 'DELETE' and not exists (select 1 from a where a.k = 1 and a.change = 'DELETE' and a.connector = l.connector and a.object = l.object)""",
    "stale_handoff": "with c as (select conv_id, turn, sha256(text) as hash from conversations), l as (select *, row_number() over (partition by conv_id order by turn desc, hash desc) as n from c) select l.conv_id, l.turn from l join c h on h.conv_id = l.conv_id and h.turn = 2 where l.n = 1 and l.hash <> h.hash",
    "finding_lifecycle": "with f as (select sha256(event_type || '|' || cast(user_id as varchar)) as finding_key, ts from events), g as (select *, coalesce(ts - lag(ts) over (partition by finding_key order by ts) > interval 3 days, false) as again from f) select finding_key, min(ts) as first_seen, max(ts) as last_seen, count(*) as n, count(*) filter (again) as reopened from g group by 1",
    "contradiction_clusters": "select user_id as subject, event_type as predicate, count(*) as n_facts, count(distinct value) as n_objects, min(event_id) as first_fact from events where event_id % 13 <> 0 group by 1, 2 having count(distinct value) > 1",
    "claim_overlaps": f"with {retrieval.DOCS}, c as (select distinct vault as prefix from docs union select distinct vault || '/en' from docs) select prefix, count(*) as n_paths from c join docs on path = prefix or starts_with(path, prefix || '/') group by 1",
    "incremental_index": "with n as (select doc_id as unit_id, sha256(text) as hash from documents), o as (select case when unit_id % 11 = 0 then -unit_id - 1 else unit_id end as unit_id, case when unit_id % 7 = 0 then 'old' else hash end as hash from n) select coalesce(o.unit_id, n.unit_id) as unit_id, case when o.unit_id is null then 'ADDED' when n.unit_id is null then 'REMOVED' when o.hash <> n.hash then 'CHANGED' else 'UNCHANGED' end as change from o full join n on o.unit_id = n.unit_id",
    "document_upsert": "with a as (select p_partkey, 1 as version, p_retailprice, false as deleted from part union all select p_partkey + 5, 2, p_retailprice * 2, p_partkey % 9 = 0 from part) select p_partkey, version, p_retailprice, deleted from a qualify row_number() over (partition by p_partkey order by version desc) = 1",
    "state_transitions": f"with s as (select lag(event_type) over (partition by user_id order by ts, event_id) as f, event_type as t from events) select f as from_state, t as to_state, count(*) as n, {_OK} as allowed from s where f is not null group by 1, 2",
    "identity_check": f"with recursive {_HITS}, e as (select query_id, count(distinct doc_id) as e from exact group by 1), x as (select query_id, count(distinct doc_id) as x from lexical group by 1) select item_id as query_id, case when e = 1 then 'SAME' when e > 1 then 'UNRESOLVED' when x > 0 then 'POSSIBLE_DUPLICATE' else 'DISTINCT' end as outcome from benchmark left join e on e.query_id = item_id left join x on x.query_id = item_id",
    "community_search": f"with recursive {_HITS}, h as (select query_id, doc_id, 1 as seed, 0 as words from exact union all select query_id, doc_id, 0, 1 from lexical), s as (select vault, count(*) as n from docs group by 1) select query_id, vault as community, round(100.0::double * max(seed) + 10.0::double * max(words) + ln(any_value(n) + 1.0::double), 6) as score from h join docs using (doc_id) join s using (vault) group by 1, 2",
    "labelled_coverage": "select source, count(*) as n, round(avg(quality), 6) as mean_quality, round(count(quality) / count(*)::double, 6) as coverage from documents d left join labels l on d.doc_id = l.doc_id group by 1",
    "raw_layer_search": f"with {retrieval.DOCS} select vault, doc_id, row_number() over (partition by vault order by case trust when 'UNVERIFIED' then 0 when 'MACHINE_SUPPORTED' then 1 when 'HUMAN_REVIEWED' then 2 else 3 end desc, length(body) desc, doc_id) as place from docs where layer in ('SOURCE', 'RESOURCE') qualify place <= 5",
}
