"""Detectors, rollups and other relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered, truth
from ..sources import bind
from .retrieval import DOCS

NOW = "timestamp '2024-01-20 00:00:00'"


def now():
    return F.expr("timestamp_ntz'2024-01-20 00:00:00'")


def missing_evidence_anti(spark, d):
    return bind.table(spark, d, "documents").select("doc_id", "source").join(bind.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def duplicate_identity(spark, d):
    docs = bind.documents(spark, d)
    keyed = docs.select("doc_id", text.normalize_identity(F.col("title")).alias("identity")).where(F.length("identity") >= 4)
    found = keyed.groupBy("identity").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return found.where("n > 1")


def interval_overlap_self_join(spark, d):
    f = bind.facts(spark, d)
    rows = f.select(F.col("fact_id").alias("id"), "subject", "predicate", "object", (F.unix_micros(F.col("valid_from").cast("timestamp")) / 1e6).alias("start"))
    rows = rows.select("id", "subject", "predicate", "object", "start", (F.col("start") + 86400.0).alias("end"))
    return truth.interval_overlap_pairs(rows, ["subject", "predicate"], 86400)


def latest_per_key(spark, d):
    e = bind.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return truth.latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


def conditional_queue_summary(spark, d):
    return ordered.queue_summary(bind.deliveries(spark, d), now()).drop("next_wake")


def severity_case_sort(spark, d):
    o = bind.table(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return o.where("o_orderstatus = 'O'").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


def orphan_nodes(spark, d):
    """Customers without an urgent order that is still open."""
    c, o = bind.table(spark, d, "customer"), bind.table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return c.select("c_custkey", "c_nationkey").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def link_gap_unique_resolution(spark, d):
    """Targets that resolve to exactly one title word of one page, by distinct count."""
    links = bind.page_links(spark, d).select("page_id", F.lower(F.regexp_replace("target", "^/", "")).alias("key")).where("key <> ''").distinct()
    pages = bind.table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    names = pages.select(F.col("page_id").alias("to_page"), F.explode(F.array_distinct(text.tokens(title))).alias("key"))
    unique = names.groupBy("key").agg(F.count_distinct("to_page").alias("n"), F.min("to_page").alias("to_page")).where("n = 1").drop("n")
    return links.join(unique, "key").where("page_id <> to_page").select("page_id", "key", "to_page")


def freshness_sla_having(spark, d):
    e = bind.table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return last.where(F.col("last_ts") < F.expr("timestamp_ntz'2024-01-31 00:00:00'") - F.expr("interval 12 hours"))


def lint_union_all(spark, d):
    docs = bind.documents(spark, d)
    checks = {
        "UNTITLED": F.trim("title") == "",
        "THIN": F.length("body") < 100,
        "STALE": F.col("freshness") != "FRESH",
        "DISPUTED": F.col("lifecycle") == "DISPUTED",
        "UNREVIEWED": F.col("trust") == "UNVERIFIED",
        "UNSAFE": text.unsafe_markup(F.col("body")),
    }
    # one scan: each row lists the checks that it fails
    failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return docs.select("vault", F.explode(failed).alias("issue")).groupBy("vault", "issue").agg(F.count("*").alias("n"))


def keyset_page(spark, d):
    return bind.table(spark, d, "orders").where("o_orderkey < 9000").orderBy(F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_custkey", "o_orderstatus")


def corpus_fingerprint(spark, d):
    """Per source, a digest of digests: documents are hashed in ranges of 1,000 ids, so
    no group holds more than that, and the ranges' digests are hashed in order."""
    docs = bind.table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.sha2("text", 256).alias("h"))
    parts = docs.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("rows"), F.count("*").alias("n"))
    parts = parts.select("source", "part", "n", F.sha2(F.array_join(F.transform("rows", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["h"])), "|"), 256).alias("digest"))
    return parts.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "|"), 256).alias("fingerprint"))


def nearest_rank_percentiles(spark, d):
    e = bind.table(spark, d, "events")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return e.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def relation_counts_distinct(spark, d):
    e = bind.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 10).alias("large"))


def null_safe_join(spark, d):
    docs, labels = bind.table(spark, d, "documents").select("doc_id", "lang"), bind.table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left")
    wanted = rows.select("lang", "quality").groupBy("lang", "quality").agg(F.count("*").alias("n")).alias("a")
    other = rows.groupBy("lang", "quality").agg(F.min("doc_id").alias("first_doc")).select(F.col("lang").alias("l2"), F.col("quality").alias("q2"), "first_doc")
    return wanted.join(other, F.col("lang").eqNullSafe(F.col("l2")) & F.col("quality").eqNullSafe(F.col("q2"))).select("lang", "quality", "n", "first_doc")


def ratio_calculation(spark, d):
    li = bind.table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_quantity"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.round(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice")), 6).alias("discount_ratio"),
    )


def lateral_top_per_row(spark, d):
    """Best order of each customer, by a max aggregate instead of a lateral subquery."""
    o = bind.table(spark, d, "orders")
    best = o.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", F.negative("o_orderkey").alias("k"))).alias("best"))
    c = bind.table(spark, d, "customer")
    return c.join(best, c.c_custkey == best.o_custkey, "left").select("c_custkey", F.negative("best.k").alias("o_orderkey"), F.col("best.o_totalprice").alias("o_totalprice"))


def compare_sets(spark, d):
    """Two hit sets side by side: parts on returned lines and on open lines."""
    li = bind.table(spark, d, "lineitem")
    left = li.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("left_n"))
    right = li.where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("r_partkey")).agg(F.count("*").alias("right_n"))
    met = left.join(right, F.col("l_partkey") == F.col("r_partkey"), "full_outer")
    return met.select(F.coalesce("l_partkey", "r_partkey").alias("partkey"), "left_n", "right_n", F.when(F.col("right_n").isNull(), "LEFT").when(F.col("left_n").isNull(), "RIGHT").otherwise("BOTH").alias("side"))


def presence_ttl(spark, d):
    """Sessions that are live at an instant: a last event within the time to live."""
    e = bind.table(spark, d, "events")
    last = e.where(F.col("ts") <= now()).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.select("user_id", "last_ts", (F.col("last_ts") + F.expr("interval 6 hours") > now()).alias("live"))


def vault_dashboard(spark, d):
    docs = bind.documents(spark, d)
    return docs.groupBy("vault").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("lifecycle") == "DISPUTED").alias("disputed"),
        F.count_if(F.col("freshness") != "FRESH").alias("stale"),
        F.count_if(F.col("trust") == "HUMAN_REVIEWED").alias("reviewed"),
        F.max("doc_id").alias("newest"),
    )


def session_turns(spark, d):
    c = bind.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max_by("role", "turn").alias("last_role"))


QUERIES = {f.__name__: f for f in (missing_evidence_anti, duplicate_identity, interval_overlap_self_join, latest_per_key, conditional_queue_summary, severity_case_sort, orphan_nodes, link_gap_unique_resolution, freshness_sla_having, lint_union_all, keyset_page, corpus_fingerprint, nearest_rank_percentiles, relation_counts_distinct, null_safe_join, ratio_calculation, lateral_top_per_row, compare_sets, presence_ttl, vault_dashboard, session_turns)}

DELIVERIES = """deliveries as (select event_id, user_id % 3 as consumer, user_id, ts, lag(event_id) over (partition by user_id order by ts, event_id) as parent_id,
  case event_id % 7 when 0 then 'PENDING' when 1 then 'SUCCEEDED' when 2 then 'RETRY' when 3 then 'SUCCEEDED' when 4 then 'CLAIMED' when 5 then 'SUCCEEDED' else 'QUARANTINED' end as status,
  cast(event_id % 5 as integer) as attempts, ts + to_seconds(event_id % 900) as next_at from events)"""

SQL = {
    "missing_evidence_anti": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "duplicate_identity": f"with {DOCS}, k as (select doc_id, regexp_replace(lower(trim(title)), '[^a-z0-9]+', '', 'g') as identity from docs) select identity, count(distinct doc_id) as n, min(doc_id) as first, max(doc_id) as last from k where length(identity) >= 4 group by 1 having count(distinct doc_id) > 1",
    "interval_overlap_self_join": "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and a.value <> b.value and a.ts < b.ts + interval 1 day and b.ts < a.ts + interval 1 day",
    "latest_per_key": "select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1",
    "conditional_queue_summary": f"""with {DELIVERIES} select consumer, count(*) filter (status = 'PENDING' and next_at <= {NOW}) as ready, count(*) filter (status = 'PENDING' and next_at > {NOW}) as waiting,
      count(*) filter (status = 'RETRY') as retry, count(*) filter (status = 'CLAIMED') as claimed, count(*) filter (status = 'SUCCEEDED') as succeeded, count(*) filter (status = 'QUARANTINED') as quarantined, count(*) as total from deliveries group by 1""",
    "severity_case_sort": "select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderstatus = 'O' order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end, o_totalprice desc, o_orderkey limit 50",
    "orphan_nodes": "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT')",
    "link_gap_unique_resolution": r"""with l as (select distinct page_id, lower(regexp_replace(t, '^/', '')) as key from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as t from pages)),
      n as (select distinct page_id as to_page, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[\p{L}\p{N}]+')) as key from pages),
      u as (select key, min(to_page) as to_page from n group by 1 having count(distinct to_page) = 1)
      select page_id, key, to_page from l join u using (key) where key <> '' and page_id <> to_page""",
    "freshness_sla_having": "select user_id, max(ts) as last_ts, count(*) as n from events group by 1 having max(ts) < timestamp '2024-01-31 00:00:00' - interval 12 hours",
    "lint_union_all": rf"""with {DOCS}, f as (select vault, 'UNTITLED' as issue from docs where trim(title) = '' union all select vault, 'THIN' from docs where length(body) < 100 union all select vault, 'STALE' from docs where freshness <> 'FRESH'
      union all select vault, 'DISPUTED' from docs where lifecycle = 'DISPUTED' union all select vault, 'UNREVIEWED' from docs where trust = 'UNVERIFIED'
      union all select vault, 'UNSAFE' from docs where regexp_matches(lower(body), '<\s*(script|iframe|object|embed)\b|\bon[a-z]+\s*=|javascript:')) select vault, issue, count(*) as n from f group by 1, 2""",
    "keyset_page": "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey < 9000 order by o_orderkey desc limit 100",
    "corpus_fingerprint": "with p as (select source, doc_id // 1000 as part, count(*) as n, sha256(string_agg(cast(doc_id as varchar) || ':' || sha256(text), '|' order by doc_id)) as digest from documents group by 1, 2) select source, cast(sum(n) as bigint) as n_docs, sha256(string_agg(digest, '|' order by part)) as fingerprint from p group by 1",
    "nearest_rank_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, min(value) as lo, max(value) as hi from events group by 1",
    "relation_counts_distinct": "select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter (value > 10) as large from events group by 1",
    "null_safe_join": "with r as (select d.doc_id, lang, quality from documents d left join labels l on d.doc_id = l.doc_id) select a.lang, a.quality, a.n, b.first_doc from (select lang, quality, count(*) as n from r group by 1, 2) a join (select lang, quality, min(doc_id) as first_doc from r group by 1, 2) b on a.lang is not distinct from b.lang and a.quality is not distinct from b.quality",
    "ratio_calculation": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_quantity, round(avg(l_discount), 6) as avg_discount, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) as discount_ratio from lineitem group by 1, 2",
    "lateral_top_per_row": "select c_custkey, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) o on o_custkey = c_custkey and n = 1",
    "compare_sets": "with a as (select l_partkey, count(*) as left_n from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey, count(*) as right_n from lineitem where l_linestatus = 'O' group by 1) select coalesce(a.l_partkey, b.l_partkey) as partkey, left_n, right_n, case when right_n is null then 'LEFT' when left_n is null then 'RIGHT' else 'BOTH' end as side from a full join b on a.l_partkey = b.l_partkey",
    "presence_ttl": f"select user_id, max(ts) as last_ts, max(ts) + interval 6 hours > {NOW} as live from events where ts <= {NOW} group by 1",
    "vault_dashboard": f"with {DOCS} select vault, count(*) as n_docs, count(*) filter (lifecycle = 'DISPUTED') as disputed, count(*) filter (freshness <> 'FRESH') as stale, count(*) filter (trust = 'HUMAN_REVIEWED') as reviewed, max(doc_id) as newest from docs group by 1",
    "session_turns": "select conv_id, count(*) as turns, count(*) filter (role = 'assistant') as answers, max_by(role, turn) as last_role from conversations group by 1",
}
