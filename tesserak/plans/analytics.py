"""Vector, graph, truth, ordered-event, evaluation and content queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, graph, ordered, truth, vectors
from ..operators.graph import cut
from ..sources import bind
from . import relational, retrieval

AT = "timestamp_ntz'2024-01-15 12:00:00'"
QUERY_VECTOR = 7


# vectors


def vector_topk(spark, d):
    e = bind.table(spark, d, "embeddings")
    query = e.where(F.col("vec_id") == QUERY_VECTOR).first()["embedding"]
    return vectors.topk(e, query, 20)


def near_duplicate_pairs(spark, d):
    return vectors.near_duplicate_pairs(bind.table(spark, d, "embeddings"), 0.35)


def _vector_units(spark, d):
    docs = bind.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.sha2("text", 256).alias("hash"))
    stored = bind.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "label")
    own = stored.join(docs, "unit_id").select("unit_id", F.when(F.col("unit_id") % 5 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash"), F.col("label").alias("generation"))
    return docs, own


def embedding_coverage(spark, d):
    return vectors.embedding_coverage(*_vector_units(spark, d))


def embedding_reuse(spark, d):
    docs, own = _vector_units(spark, d)
    return vectors.embedding_reuse(docs, own.withColumnRenamed("unit_id", "vector_id"))


def hash_embedding(spark, d):
    return vectors.hash_embedding(bind.table(spark, d, "documents").select("doc_id", F.col("text").alias("body")))


def l2_violations(spark, d):
    """Stored vectors, of which every 37th is scaled and every 41st cut short."""
    e = bind.table(spark, d, "embeddings")
    scaled = F.when(F.col("vec_id") % 37 == 0, F.transform("embedding", lambda v: v * F.lit(1.5).cast("float"))).when(F.col("vec_id") % 41 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vectors.l2_violations(e.select("vec_id", scaled.alias("embedding")), 64)


# graph


def _seeds(spark, d):
    return bind.table(spark, d, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("seed"))


def _nations(spark, d):
    return bind.table(spark, d, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("seed"))


def expand_graph(spark, d):
    suppliers = bind.table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("seed"))
    return graph.expand_graph(suppliers, bind.edges(spark, d), hops=3)


def weighted_paths(spark, d):
    return graph.weighted_paths(_seeds(spark, d), bind.edges(spark, d), hops=2, fan_out=10)


def best_paths(spark, d):
    return graph.best_paths(_nations(spark, d), bind.edges(spark, d))


def downstream_invalidation(spark, d):
    return graph.closure(_seeds(spark, d), bind.edges(spark, d))


def one_hop_neighbours(spark, d):
    return graph.one_hop_neighbours(_nations(spark, d), bind.edges(spark, d))


def graph_summary(spark, d):
    return graph.graph_summary(bind.edges(spark, d))


def connected_components(spark, d):
    return graph.connected_components(bind.edges(spark, d).where("weight >= 0.3"))


def ppr_k_iterations(spark, d):
    seeds = bind.table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("seed"), F.lit(1.0).alias("weight"))
    return graph.ppr(seeds, bind.edges(spark, d), rounds=3)


def ppr_converged(spark, d):
    seeds = bind.table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("seed"), F.lit(1.0).alias("weight"))
    return graph.ppr(seeds, bind.edges(spark, d), rounds=20, tolerance=1e-4)


def leiden_communities(spark, d):
    """The partition of all regions, nations, suppliers and customers: every one with its
    community, the community's key, size and quality, and the edges that support it."""
    e, nodes = bind.edges(spark, d), bind.nodes(spark, d)
    return graph.memberships(e, graph.communities(e, nodes=nodes), nodes=nodes)


def copy_communities(spark, d):
    """Communities of documents that are tied to the first one of their text: with ties
    that outweigh any size, these are the groups of equal texts."""
    t = bind.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = t.groupBy("hash").agg(F.min("doc_id").alias("first"))
    ties = t.join(first, "hash").where("doc_id <> first").select(F.col("first").alias("from_id"), F.col("doc_id").alias("to_id"), F.lit(1e6).alias("weight"))
    return graph.communities(ties).select(F.col("node").cast("long").alias("doc_id"), "community")


# truth


def facts_asof(spark, d):
    f = bind.facts(spark, d)
    rows = truth.facts_asof(f, bind.supersessions(f), F.expr(AT), F.expr(AT))
    return rows.select("fact_id", "subject", "predicate", "object")


def truth_state(spark, d):
    f = bind.facts(spark, d)
    return truth.truth_state(f, bind.supersessions(f), F.expr(AT))


def supersession_checks(spark, d):
    f = bind.facts(spark, d)
    return truth.supersession_violations(f, bind.supersessions(f))


def _support(spark, d):
    e = bind.table(spark, d, "events")
    evidence = e.select(F.col("event_id").alias("set_id"), (F.col("event_id") % 2).alias("group_no"), F.lit("EVIDENCE").alias("ref_kind"), F.concat(F.lit("e"), (F.col("event_id") % 97).cast("string")).alias("ref_id"))
    fact = e.where("event_id % 3 = 0").select(F.col("event_id").alias("set_id"), (F.col("event_id") % 2).alias("group_no"), F.lit("FACT").alias("ref_kind"), (F.col("event_id") + 1).cast("string").alias("ref_id"))
    sets = evidence.unionByName(fact).withColumn("set_id", F.col("set_id").cast("string"))
    states = e.select((F.col("event_id") % 97).alias("k")).distinct().select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("ref_id"), F.when(F.col("k") % 13 == 0, 0).when(F.col("k") % 11 == 0, 1).otherwise(2).alias("level"))
    return sets, states


def support_eval(spark, d):
    return truth.support_eval(*_support(spark, d))


def validate_derived(spark, d):
    users = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    e = bind.table(spark, d, "events")
    deps = e.select(F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "UNSUPPORTED").when(F.col("event_id") % 5 == 0, "DISPUTED").otherwise("SUPPORTED").alias("state"))
    return truth.validate_derived(users, deps, F.expr("timestamp_ntz'2024-01-02 00:00:00'"))


# ordered events


def gap_ordered_apply(spark, d):
    return ordered.apply_changes(ordered.gap_free_prefix(bind.inbox(spark, d)))


def claimable_events(spark, d):
    return ordered.claimable(bind.deliveries(spark, d), relational.now())


def retry_schedule(spark, d):
    rows = bind.deliveries(spark, d).where("status = 'RETRY'")
    unit = (F.col("event_id") % 11) / 10.0
    late = F.col("attempts") + 1 >= 5
    return rows.select("event_id", "attempts", F.when(late, "QUARANTINED").otherwise("RETRY").alias("next_status"), F.when(~late, ordered.retry_delay(F.col("attempts") + 1, unit)).alias("delay"))


def change_coalesce(spark, d):
    return ordered.coalesce_changes(bind.inbox(spark, d))


def idempotent_dedupe(spark, d):
    e = bind.table(spark, d, "events")
    rows = e.select((F.col("event_id") % 2000).alias("event_id"), F.col("ts").alias("at"), F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string")).alias("content"))
    return ordered.idempotent(rows)


# evaluation


def _gold(spark, d):
    """(query_id, gold): documents that hold a benchmark passage as a whole.  Written, for
    it is read more than once."""
    b = bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    found = evaluation.holders(b, bind.table(spark, d, "documents").select("doc_id", "text"))
    gold = found.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))
    return cut(b.select("query_id").join(gold, "query_id", "left").select("query_id", F.coalesce("gold", F.array().cast("array<long>")).alias("gold")))


def score_retrieval(spark, d):
    return evaluation.score_retrieval(_gold(spark, d), retrieval.fused_hits(spark, d).select("query_id", "doc_id", "rank"))


def _observations(spark, d):
    cases = _gold(spark, d).select("query_id", (F.size("gold") == 0).alias("expect_no_answer"))
    hits = retrieval.fused_hits(spark, d).select("query_id", F.lit(True).alias("returned")).distinct()
    return evaluation.score_observation(score_retrieval(spark, d), cases, hits)


def score_observation(spark, d):
    return _observations(spark, d)


#: Configurations that are run, with their channels.
CONFIGURATIONS = {
    "context-pack-only": ["context-pack"],
    "exact+lexical": ["exact", "lexical"],
    "vector-only": ["vector"],
    "graph-only": ["graph"],
    "lexical+vector": ["lexical", "vector"],
    "lexical+graph": ["lexical", "graph"],
    "vector+graph": ["vector", "graph"],
    "context-pack+lexical+graph": ["context-pack", "lexical", "graph"],
    "full-hybrid-rrf": ["context-pack", "exact", "lexical", "vector", "graph"],
    "lexical+vector+graph": ["lexical", "vector", "graph"],
}


def _run_scores(spark, d, configurations):
    """Scores of configurations over the benchmark: the channels' rows are copied to the
    configurations that use them and fused per (configuration, query)."""
    names = F.create_map(*[x for n, c in configurations.items() for x in (F.lit(n), F.array(*map(F.lit, c)))])
    each = F.explode(F.array(*map(F.lit, configurations))).alias("configuration")
    rows = retrieval._channels(spark, d).select("*", each).where(F.array_contains(names[F.col("configuration")], F.col("channel")))
    key = F.concat_ws("#", "configuration", F.col("query_id").cast("string"))
    fused = retrieval.rrf_fuse_rows(rows.withColumn("query_id", key), 10)
    cases = _gold(spark, d).select(each, "query_id", "gold")
    scored = evaluation.score_retrieval(cases.select(key.alias("query_id"), "gold"), fused.select("query_id", "doc_id", "rank"))
    sizes = cases.select(key.alias("query_id"), "configuration", (F.size("gold") == 0).alias("none"))
    met = scored.join(sizes, "query_id")
    return met.select("configuration", "recall", "rr", F.when(~F.col("none"), F.col("ndcg")).alias("ndcg"), F.col("hit").alias("passed"))


def runs_of(spark, d, names):
    """The aggregates of the configurations that are named."""
    return evaluation.aggregate_run(_run_scores(spark, d, {n: CONFIGURATIONS[n] for n in names}))


def aggregate_run(spark, d):
    return runs_of(spark, d, CONFIGURATIONS)


def select_default(spark, d):
    runs = aggregate_run(spark, d).select("configuration", F.col("configuration").isin([n for n, c in CONFIGURATIONS.items() if "vector" in c]).alias("uses_vectors"), "mrr", "mean_recall")
    return evaluation.select_default(runs)


def promotion_gates(spark, d):
    """Which releases (nations) may make the measured winner the default."""
    runs = aggregate_run(spark, d).withColumn("uses_vectors", F.col("configuration").isin([n for n, c in CONFIGURATIONS.items() if "vector" in c]))
    gate = F.posexplode(F.array(*map(F.lit, evaluation.GATES))).alias("i", "gate")
    evidence = bind.table(spark, d, "nation").select(F.col("n_name").alias("release"), "n_nationkey", gate).withColumn("passed", F.expr("n_nationkey % 7 = 0 or shiftright(n_nationkey, 1) % (i + 2) <> 1"))
    return evaluation.promotion(runs, evidence.select("release", "gate", "passed"))


# content


def chunk_units(spark, d):
    return bind.units(spark, d)


def html_text(spark, d):
    p = bind.table(spark, d, "pages")
    plain = F.regexp_replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), plain.alias("content"))


def symbol_text(spark, d):
    return bind.table(spark, d, "part").select("p_partkey", text.symbol_text(F.concat_ws("", F.col("p_brand"), F.lit("XMLParser_getName"), F.col("p_type"))).alias("symbols"))


def query_decompose(spark, d):
    """Whole benchmark texts, each with a comparison after it."""
    b = bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), F.lit("; one  thing VS another vs ab versus the "), F.lower("text")).alias("q"))
    return b.select("query_id", F.posexplode(text.query_parts(F.col("q"))).alias("part_no", "part"))


def classify_query(spark, d):
    """The shapes of whole benchmark texts and of what users say."""
    b = bind.table(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), F.lit(0).alias("turn"), "text")
    c = bind.table(spark, d, "conversations").where("role = 'user'").select(F.lit("user").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return b.unionByName(c).select("kind", "id", "turn", text.shapes(F.col("text")).alias("shapes"))


def normalize_identity(spark, d):
    return bind.table(spark, d, "customer").select("c_custkey", text.normalize_identity(F.col("c_name")).alias("identity"))


def page_link_counts(spark, d):
    return bind.page_links(spark, d).groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("target").alias("first_target"))


def revision_chain(spark, d):
    rows = bind.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("vault"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("content"))
    return truth.revision_chain(rows)


def daily_event_windows(spark, d):
    """Tumbling days over events (an extra of Spark's own)."""
    e = bind.table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def event_sessions(spark, d):
    """Sessions of a user: a gap of six hours or more begins a new one (an extra)."""
    e = bind.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) >= F.expr("interval 6 hours"))).cast("int")
    rows = e.withColumn("new", new).withColumn("session_no", F.sum("new").over(w))
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


QUERIES = {f.__name__: f for f in (promotion_gates, copy_communities, vector_topk, near_duplicate_pairs, embedding_coverage, embedding_reuse, hash_embedding, l2_violations, expand_graph, weighted_paths, best_paths, downstream_invalidation, one_hop_neighbours, graph_summary, connected_components, ppr_k_iterations, ppr_converged, leiden_communities, facts_asof, truth_state, supersession_checks, support_eval, validate_derived, gap_ordered_apply, claimable_events, retry_schedule, change_coalesce, idempotent_dedupe, score_retrieval, score_observation, aggregate_run, select_default, chunk_units, html_text, symbol_text, query_decompose, classify_query, normalize_identity, page_link_counts, revision_chain, daily_event_windows, event_sessions)}

_AT = "timestamp '2024-01-15 12:00:00'"
EDGES = """edges as (select 'N:' || n_nationkey as from_id, 'R:' || n_regionkey as to_id, 'related_to' as relation, 1.0::double as weight from nation
  union all select 'S:' || s_suppkey, 'N:' || s_nationkey, 'derives_from', 1.0::double / (1 + s_suppkey % 4) from supplier
  union all select 'N:' || c_nationkey, 'C:' || c_custkey, 'supports', 1.0::double / (1 + c_custkey % 5) from customer)"""
ORIENTED = f"{EDGES}, oriented as (select from_id as src, to_id as dst, relation, weight from edges union all select to_id, from_id, relation, weight from edges)"
FACTS = "facts as (select event_id as fact_id, user_id as subject, event_type as predicate, value as object, ts as valid_from, ts + interval 1 day as valid_to, event_id % 13 = 0 as withdrawn, lead(event_id) over (partition by user_id, event_type order by ts, event_id) as new_id from events)"
VECTOR_UNITS = """units as (select doc_id as unit_id, sha256(text) as hash from documents),
own as (select unit_id, case when unit_id % 5 = 0 then 'stale' else hash end as hash, label as generation from units join embeddings on vec_id = unit_id)"""
INBOX = """inbox as (select user_id as connector, sequence, event_id, 'o' || (event_id % 7) as object, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as change, value
  from (select *, row_number() over (partition by user_id order by ts, event_id) as sequence from events) where event_id % 29 <> 0)"""
GOLD = """found as (select b.item_id as query_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)),
gold as (select b.item_id as query_id, count(f.doc_id) as n_gold from benchmark b left join found f on f.query_id = b.item_id group by 1)"""
SCORES = f"""{retrieval.HYBRID}, {GOLD},
per as (select r.query_id, count(*) as n, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from ranked r join found f using (query_id, doc_id) where rank <= 10 group by 1),
scores as (select g.query_id, case when n_gold = 0 then 1.0 else round(coalesce(n, 0) / n_gold::double, 6) end as recall, round(coalesce(n, 0) / 10.0::double, 6) as precision, round(coalesce(1.0::double / first, 0), 6) as rr,
  round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, greatest(least(n_gold, 10), 1)), lambda i: 1 / log2(i + 1))), 6) as ndcg, coalesce(n, 0) > 0 as hit from gold g left join per using (query_id))"""
_USES = " union all ".join(f"select '{n}' as configuration, '{c}' as channel" for n, cs in CONFIGURATIONS.items() for c in cs)
RUN = f"""{retrieval.HYBRID}, {GOLD}, uses as ({_USES}), names as (select distinct configuration from uses),
weights as (select * from (values ('exact', 3.0::double), ('context-pack', 2.5), ('lexical', 1.5), ('graph', 1.4), ('raw', 1.2), ('vector', 1.0)) t(channel, weight)),
cf as (select configuration, query_id, doc_id, round(sum(weight / (60 + rank) order by channel), 8) as score from channels join uses using (channel) join weights using (channel) group by 1, 2, 3),
cr as (select *, row_number() over (partition by configuration, query_id order by score desc, doc_id) as rank from cf),
cp as (select configuration, r.query_id, count(*) as n, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from cr r join found f using (query_id, doc_id) where rank <= 10 group by 1, 2),
s as (select configuration, case when n_gold = 0 then 1.0 else round(coalesce(n, 0) / n_gold::double, 6) end as recall, round(coalesce(1.0::double / first, 0), 6) as rr,
  case when n_gold > 0 then round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, greatest(least(n_gold, 10), 1)), lambda i: 1 / log2(i + 1))), 6) end as ndcg, coalesce(n, 0) > 0 as passed
  from gold cross join names left join cp using (configuration, query_id)),
agg as (select configuration, count(*) as cases, round(avg(recall), 6) as mean_recall, round(avg(rr), 6) as mrr, round(avg(ndcg), 6) as mean_ndcg, round(avg(passed::int), 6) as pass_rate, round(count(ndcg) / count(*)::double, 6) as ndcg_coverage from s group by 1)"""


def _ppr(rounds: int) -> str:
    steps = ", ".join(
        f"s{i} as materialized (select b.node, b.p, b.out, 0.15 * b.p + 0.85 * (coalesce(f.got, 0) + st.stuck * b.p) as score from s{i - 1} b left join (select to_id as node, sum(score * share) as got from s{i - 1} join share on node = from_id group by 1) f using (node) cross join (select sum(case when not out then score else 0 end) as stuck from s{i - 1}) st)"
        for i in range(1, rounds + 1)
    )
    return f"""with {EDGES}, m as (select from_id, to_id, relation, max(weight) as weight from edges group by 1, 2, 3), e as (select from_id, to_id, sum(weight) as weight from m group by 1, 2),
      share as materialized (select from_id, to_id, weight / sum(weight) over (partition by from_id) as share from e), start as (select 'S:' || s_suppkey as node, 1.0::double / count(*) over () as p from supplier),
      nodes as (select from_id as node from share union select to_id from share union select node from start),
      s0 as materialized (select n.node, coalesce(p, 0) as p, n.node in (select from_id from share) as out, coalesce(p, 0) as score from nodes n left join start using (node)), {steps} select node, round(score, 8) as score from s{rounds}"""



def _shapes_sql() -> str:
    cases = []
    for name, cues in text.SHAPES.items():
        single = ", ".join(f"'{c}'" for c in cues if " " not in c)
        phrases = "".join(f" or contains(line, ' {c} ')" for c in cues if " " in c)
        cases.append(f"case when list_has_any(w, [{single}]){phrases} then '{name}' end")
    return f"""with t as (select 'benchmark' as kind, item_id as id, 0 as turn, text from benchmark union all select 'user', conv_id, turn, text from conversations where role = 'user'),
      w as (select kind, id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' as line from t)
      select kind, id, turn, concat_ws(',', {", ".join(cases)}) as shapes from w"""


SQL = {
    "vector_topk": f"with q as (select embedding::double[] as q from embeddings where vec_id = {QUERY_VECTOR}) select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q order by 2 desc, 1 limit 20",
    "near_duplicate_pairs": "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35",
    "embedding_coverage": f"with {VECTOR_UNITS} select count(u.unit_id) as expected, count(o.unit_id) as stored, count(*) filter (u.hash = o.hash) as matching from units u full join own o on u.unit_id = o.unit_id",
    "embedding_reuse": f"with {VECTOR_UNITS}, best as (select hash, unit_id as vector_id from (select *, row_number() over (partition by hash order by generation desc, unit_id desc) as n from own) where n = 1) select unit_id, vector_id, vector_id is null as to_compute from units left join best using (hash)",
    "copy_communities": "select doc_id, min(cast(doc_id as varchar)) over (partition by sha256(text)) as community from documents qualify count(*) over (partition by sha256(text)) > 1",
    "hash_embedding": r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as token from documents), c as (select doc_id, sha256(token) as h, count(*) as n from w group by doc_id, token),
      s as (select doc_id, cast(('0x' || h[1:4]) as bigint) % 32 as idx, cast(sum(case when cast(('0x' || h[5:6]) as bigint) % 2 = 0 then n else -n end) as bigint) as v from c group by 1, 2)
      select doc_id, idx, round(v / sqrt(sum(v * v) over (partition by doc_id)::double), 6) as value from s where v <> 0""",
    "l2_violations": "with e as (select vec_id, case when vec_id % 37 = 0 then list_transform(embedding, lambda v: (v * 1.5::float)::float) when vec_id % 41 = 0 then embedding[1:63] else embedding end as embedding from embeddings) select vec_id from e where len(embedding) <> 64 or abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) >= 0.001",
    "expand_graph": f"""with recursive {EDGES}, top as (select * from (select *, row_number() over (partition by from_id order by weight desc, to_id, relation) as n from edges) where n <= 50), w as (select 'S:' || s_suppkey as node, 1.0::double as score, ['S:' || s_suppkey] as path, 0 as hops from supplier
      union all select e.to_id, w.score * e.weight * 0.5, list_append(w.path, e.to_id), hops + 1 from w join top e on e.from_id = w.node where hops < 3 and not list_contains(w.path, e.to_id)) select node, round(sum(score), 6) as score from w where hops > 0 group by 1""",
    "weighted_paths": f"""with recursive {ORIENTED}, top as (select * from (select *, row_number() over (partition by src order by weight desc, dst, relation) as n from oriented) where n <= 10),
      w as (select 'R:' || r_regionkey as seed, 'R:' || r_regionkey as node, 1.0::double as score, ['R:' || r_regionkey] as path, 0 as hops from region
      union all select w.seed, t.dst, w.score * t.weight * 0.5, list_append(w.path, t.dst), hops + 1 from w join top t on t.src = w.node where hops < 2 and not list_contains(w.path, t.dst)),
      d as (select seed, node, hops, path, max(score) as score from w where hops > 0 group by 1, 2, 3, 4),
      r as (select *, row_number() over (partition by node order by score desc, hops, seed, array_to_string(path, '>')) as n from d) select node, round(sum(score), 6) as score, count(*) as paths from r where n <= 3 group by 1""",
    "best_paths": f"""with recursive {EDGES}, w as (select 'N:' || n_nationkey as seed, 'N:' || n_nationkey as node, 0::bigint as hops, 'N:' || n_nationkey as signature, ['N:' || n_nationkey] as path from nation
      union all select w.seed, e.to_id, w.hops + 1, w.signature || '>' || e.to_id, list_append(w.path, e.to_id) from w join (select distinct from_id, to_id from edges) e on e.from_id = w.node where w.hops < 4 and not list_contains(w.path, e.to_id))
      select seed, node, hops, signature from (select *, row_number() over (partition by seed, node order by hops, signature) as n from w where hops > 0) where n = 1""",
    "downstream_invalidation": f"""with recursive {EDGES}, w as (select 'R:' || r_regionkey as node, 0::bigint as depth from region union select e.from_id, w.depth + 1 from w join edges e on e.to_id = w.node where depth < 12)
      select node, min(depth) as depth from w group by 1 having min(depth) > 0""",
    "one_hop_neighbours": f"with {ORIENTED}, s as (select 'N:' || n_nationkey as seed from nation) select dst as node, max(weight) as weight, min(relation) as relation from oriented where src in (select seed from s) and dst not in (select seed from s) group by 1",
    "graph_summary": f"with {EDGES} select relation, count(*) as n_edges, round(sum(weight), 6) as total_weight from edges group by 1",
    "connected_components": f"with recursive {EDGES}, o as (select distinct from_id as src, to_id as dst from edges where weight >= 0.3 union select distinct to_id, from_id from edges where weight >= 0.3), w as (select src as node, src as component from o union select o.dst, w.component from w join o on o.src = w.node where w.component < o.dst) select node, min(component) as component from w group by 1",
    "ppr_k_iterations": _ppr(3),
    "facts_asof": f"with {FACTS} select fact_id, subject, predicate, object from facts f where valid_from <= {_AT} and valid_to > {_AT} and not exists (select 1 from facts n where n.fact_id = f.new_id and n.valid_from <= {_AT} and n.valid_to > {_AT})",
    "truth_state": f"""with {FACTS} select f.fact_id, case when n.valid_from <= {_AT} and n.valid_to > {_AT} then 'SUPERSEDED' when f.valid_from > {_AT} then 'FUTURE_EFFECTIVE' when f.valid_to <= {_AT} then 'HISTORICAL' when f.withdrawn then 'UNSUPPORTED' else 'SUPPORTED_CURRENT' end as state
      from facts f left join facts n on n.fact_id = f.new_id""",
    "supersession_checks": f"with {FACTS} select o.fact_id as old_id, n.fact_id as new_id, case when n.valid_from < o.valid_from then 'ORDER' else 'NO_CHANGE' end as violation from facts o join facts n on n.fact_id = o.new_id where n.valid_from < o.valid_from or n.object = o.object",
    "support_eval": """with e as (select event_id, case when (event_id % 97) % 13 = 0 then 0 when (event_id % 97) % 11 = 0 then 1 else 2 end as own from events)
      select cast(a.event_id as varchar) as set_id, case case when a.event_id % 3 = 0 then least(a.own, coalesce(b.own, 0)) else a.own end when 0 then 'UNSUPPORTED' when 1 then 'DISPUTED' else 'SUPPORTED' end as state from e a left join e b on b.event_id = a.event_id + 1""",
    "validate_derived": """with l as (select user_id, max_by(case when event_id % 7 = 0 then 'UNSUPPORTED' when event_id % 5 = 0 then 'DISPUTED' else 'SUPPORTED' end, (ts, event_id)) filter (ts <= timestamp '2024-01-02 00:00:00') as state from events group by 1),
      s as (select c_custkey as item_id, case when l.user_id is null then 'UNANNOTATED' when l.state is null then 'UNSUPPORTED' else l.state end as state from customer left join l on l.user_id = c_custkey) select item_id, state, state <> 'UNSUPPORTED' as valid from s""",
    "gap_ordered_apply": f"""with {INBOX}, p as (select * from (select *, row_number() over (partition by connector order by sequence) as n from inbox) where n = sequence), l as (select *, row_number() over (partition by connector, object order by sequence desc) as k from p)
      select connector, object, sequence, change = 'DELETE' as deleted, case when change <> 'DELETE' then value end as value from l where k = 1""",
    "claimable_events": f"with {relational.DELIVERIES} select d.event_id, d.consumer from deliveries d left join deliveries p on p.event_id = d.parent_id where d.status in ('PENDING', 'RETRY', 'CLAIMED') and d.next_at <= {relational.NOW} and (d.parent_id is null or p.status is null or (p.consumer = d.consumer and p.status = 'SUCCEEDED'))",
    "retry_schedule": f"with {relational.DELIVERIES} select event_id, attempts, case when attempts + 1 >= 5 then 'QUARANTINED' else 'RETRY' end as next_status, case when attempts + 1 < 5 then least(300.0::double, round(least(300.0::double, 1.0::double * pow(2.0, attempts)) * (1 + (2 * ((event_id % 11) / 10.0::double) - 1) * 0.2::double), 3)) end as delay from deliveries where status = 'RETRY'",
    "change_coalesce": f"with {INBOX} select connector, object, case when count(*) filter (change = 'DELETE') > 0 then 'DELETE' else 'UPSERT' end as change, count(*) as n from inbox group by 1, 2",
    "idempotent_dedupe": "with a as (select event_id % 2000 as event_id, ts as t, event_type || ':' || (event_id % 3) as content from events) select event_id, first(content order by t, content) as first_content, count(*) - count(distinct content) as repeats, count(distinct content) - 1 as conflicts from a group by 1",
    "score_retrieval": f"with recursive {SCORES} select query_id, recall, precision, rr, ndcg, hit from scores",
    "score_observation": f"""with recursive {SCORES}, o as (select s.query_id, n_gold = 0 as expect_no_answer, case when n_gold = 0 then 1.0 else recall end as recall, rr, ndcg, (s.query_id in (select query_id from ranked where rank <= 10)) <> (n_gold = 0) as no_answer_right from scores s join gold g using (query_id))
      select query_id, expect_no_answer, recall, rr, ndcg, no_answer_right, case when expect_no_answer then no_answer_right else recall > 0 end as passed from o""",
    "aggregate_run": f"with recursive {RUN} select * from agg",
    "select_default": f"""with recursive {RUN}, r as (select configuration, configuration in (select configuration from uses where channel = 'vector') as v, mrr, mean_recall from agg), p as (select max(mrr) as bm, max(mean_recall) as br from r where not v),
      g as (select r.*, not v or (mrr >= bm + 0.02 and mean_recall >= br) as eligible from r, p) select configuration, mrr, mean_recall, eligible, eligible and row_number() over (partition by eligible order by mrr desc, mean_recall desc, configuration) = 1 as selected from g""",
    "promotion_gates": f"""with recursive {RUN}, r as (select *, configuration in (select configuration from uses where channel = 'vector') as v from agg), b as (select *, row_number() over (partition by v order by mrr desc, coalesce(mean_ndcg, 0) desc, mean_recall desc, configuration) as n from r),
      t as (select max(configuration) filter (not v) as baseline, max(configuration) filter (v) as best_vector, max(mrr) filter (v) >= max(mrr) filter (not v) + 0.02 and max(mean_recall) filter (v) >= max(mean_recall) filter (not v) as ahead from b where n = 1),
      g as (select n_name as release, n_nationkey as k, unnest({evaluation.GATES}) as gate, unnest(range(0, {len(evaluation.GATES)})) as i from nation),
      e as (select release, coalesce(string_agg(gate, ',' order by i) filter (not (k % 7 = 0 or (k // 2) % (i + 2) <> 1)), '') as missing_gates from g group by 1)
      select release, baseline, best_vector, case when ahead then best_vector else baseline end as measured, missing_gates, missing_gates = '' as eligible, case when missing_gates = '' then case when ahead then best_vector else baseline end end as selected from e, t""",
    "chunk_units": "select doc_id, cast(position as bigint) as position, content, sha256(content) as hash, cast(ceil(length(content) / 4.0) as bigint) as tokens from (select doc_id, unnest(generate_series(0, len(l) - 1)) as position, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents)) where trim(content) <> ''",
    "html_text": r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as content from pages",
    "symbol_text": r"select p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(p_brand || 'XMLParser_getName' || p_type, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) as symbols from part",
    "query_decompose": r"""with q as (select item_id as query_id, trim(regexp_replace(text || '; one  thing VS another vs ab versus the ' || lower(text), '[ \t\r\n]+', ' ', 'g')) as q from benchmark),
      p as (select query_id, q, list_filter(list_transform(regexp_split_to_array(q, '(?i)(?:\s*;\s*|\s*\n+\s*|\s+\bvs\.?\b\s+|\s+\bversus\b\s+|\s+\bfrente\s+a\b\s+|\s+\bcontra\b\s+)'), lambda x: trim(x)), lambda x: length(x) >= 3) as a from q),
      u as (select query_id, q, unnest(a) as part, generate_subscripts(a, 1) as i from p), f as (select query_id, part, min(i) as i from u where lower(part) <> lower(q) group by 1, 2),
      n as (select query_id, part, cast(row_number() over (partition by query_id order by i) - 1 as integer) as part_no from f) select query_id, part_no, part from n where part_no < 4""",
    "classify_query": _shapes_sql(),
    "normalize_identity": "select c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '', 'g') as identity from customer",
    "page_link_counts": """select page_id, count(*) as n_links, min(t) as first_target from (select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as t from pages) group by 1""",
    "revision_chain": "with recursive r as (select o_custkey::varchar as vault, o_orderkey as seq, o_orderpriority as content, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), c as (select vault, seq, n, sha256('|' || content) as hash from r where n = 1 union all select r.vault, r.seq, r.n, sha256(c.hash || '|' || r.content) from c join r on r.vault = c.vault and r.n = c.n + 1) select vault, seq, hash from c",
    "daily_event_windows": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "event_sessions": "with a as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), b as (select *, cast(sum(new) over (partition by user_id order by ts, event_id) as bigint) as session_no from a) select user_id, session_no, count(*) as n, min(ts) as begins, max(ts) as ends from b group by 1, 2",
}
