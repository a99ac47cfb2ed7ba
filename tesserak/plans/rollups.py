"""Rollups, exports and best-row queries over the model's views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import bind


def profile_usage_counts(spark, d):
    """Documents per layer and per lifecycle and freshness, in one pass; relations per type."""
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("name"), b.alias("detail"))
    docs = bind.documents(spark, d).select("layer", "lifecycle", "freshness")
    used = docs.select(F.inline(F.array(pair("LAYER", F.col("layer"), F.lit("")), pair("STATE", F.col("lifecycle"), F.col("freshness")))))
    relations = bind.edges(spark, d).select(F.lit("RELATION").alias("kind"), F.col("relation").alias("name"), F.lit("").alias("detail"))
    return used.unionByName(relations).groupBy("kind", "name", "detail").agg(F.count("*").alias("n"))


def graph_health_rollup(spark, d):
    """Per domain: states of each scope's newest revision, the latest time, and scopes without any."""
    orders = bind.table(spark, d, "orders")
    newest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("top"))
    scopes = bind.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("domain"))
    state = F.col("top.o_orderstatus")
    rows = scopes.join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("domain").agg(F.count_if(state == "O").alias("active"), F.count_if(state == "F").alias("stale"), F.count_if(state == "P").alias("building"), F.count_if(F.col("top").isNull()).alias("missing"), F.max("top.o_orderdate").alias("latest"))


def project_counts(spark, d):
    """Per project: nodes, edges and the latest failed run; projects without any keep zeros."""
    customers = bind.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nodes = customers.groupBy("c_nationkey").agg(F.count("*").alias("n_nodes"))
    runs = bind.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    runs = runs.groupBy(F.col("c_nationkey").alias("run_of")).agg(F.count("*").alias("n_edges"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))).alias("latest_error"))
    nation = bind.table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = nation.join(nodes, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(runs, F.col("n_nationkey") == F.col("run_of"), "left")
    return rows.select("n_name", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "latest_error")


def support_sets_containing(spark, d):
    """For each wanted id: how many support sets contain it, and the first of them.

    Members are joined by equality before any set is formed, so no set is searched.
    """
    wanted = bind.table(spark, d, "part").where("p_size <= 2").select("p_partkey")
    members = bind.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(wanted, F.col("l_partkey") == F.col("p_partkey"))
    return members.groupBy("p_partkey").agg(F.countDistinct("l_orderkey").alias("n_sets"), F.min("l_orderkey").alias("first_set"))


def synthesis_candidates(spark, d):
    """Communities of three or more active documents that share a text."""
    docs = bind.documents(spark, d).where("lifecycle = 'ACTIVE'").select(F.col("digest").alias("community"), "doc_id")
    return docs.groupBy("community").agg(F.count("*").alias("n_members"), F.min("doc_id").alias("lead")).where("n_members >= 3")


def revision_set_hash(spark, d):
    """Digest of each set's members in order; a set is one order's lines."""
    lines = bind.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    texts = F.transform("lines", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string")))
    return lines.select("l_orderkey", F.sha2(F.array_join(texts, ","), 256).alias("set_hash"))


def recency_truncation(spark, d, most: int = 50):
    """The newest nodes across two sources; each source gives its own newest first."""
    orders = bind.table(spark, d, "orders").select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    events = bind.table(spark, d, "events").select(F.lit("events").alias("origin"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    by = [F.col("moment").desc(), "origin", "id"]
    return orders.orderBy(*by).limit(most).unionByName(events.orderBy(*by).limit(most)).orderBy(*by).limit(most)


def bounded_export(spark, d, most: int = 100):
    """The first rows in a total order and whether more were left out (one row more is fetched)."""
    by = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    fetched = bind.table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(*by).limit(most + 1)
    rows = fetched.withColumn("place", F.row_number().over(Window.orderBy(*by))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return rows.where(F.col("place") <= most)


def best_row_per_key(spark, d):
    """Per key the row of the greatest score; a tie prefers untransformed rows, then the smallest id."""
    lines = bind.table(spark, d, "lineitem")
    rank = F.struct(F.col("l_quantity"), (F.col("l_discount") == 0).alias("plain"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))
    best = lines.groupBy("l_partkey").agg(F.max(rank).alias("top"))
    return best.select("l_partkey", (-F.col("top.o")).alias("l_orderkey"), (-F.col("top.n")).alias("l_linenumber"), F.col("top.l_quantity").alias("l_quantity"))


def work_claim_findings(spark, d):
    """Claims that are open on closed work, and claims whose lease lapsed before the work's state was taken."""
    work = bind.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    claims = bind.table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate").join(work, F.col("l_orderkey") == F.col("o_orderkey"))
    lapsed = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))
    found = F.array_compact(F.array(F.when((F.col("o_orderstatus") == "F") & (F.col("l_linestatus") == "O"), "ORPHAN_WORK"), F.when(lapsed, "EXPIRED_CLAIM")))
    return claims.select("o_orderpriority", "l_orderkey", F.explode(found).alias("detector")).groupBy("detector", "o_orderpriority").agg(F.count("*").alias("n_claims"), F.min("l_orderkey").alias("first_work"))


def acronym_terms(spark, d, most: int = 3):
    """The first distinct acronyms of each text: 3 to 8 capitals or digits, a capital first."""
    tokens = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda x: x.rlike("^[A-Z][A-Z0-9]{2,7}$"))
    return bind.table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(tokens), 1, most), ",").alias("acronyms")).where("acronyms <> ''")


def needle_window(spark, d, needle: str = "license", half: int = 40):
    """An excerpt around the first place of a needle, with ellipses where text was left out."""
    at = F.instr(F.lower("text"), needle)
    docs = bind.table(spark, d, "documents").select("doc_id", "text", at.alias("place")).where("place > 0")
    start = F.greatest(F.col("place") - half, F.lit(1))
    size = F.lit(2 * half + len(needle))
    cut_end = start + size - 1 < F.length("text")
    excerpt = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(F.col("text"), start, size), F.when(cut_end, "...").otherwise(""))
    return docs.select("doc_id", "place", excerpt.alias("excerpt"))


QUERIES = {f.__name__: f for f in (profile_usage_counts, graph_health_rollup, project_counts, support_sets_containing, synthesis_candidates, revision_set_hash, recency_truncation, bounded_export, best_row_per_key, work_claim_findings, acronym_terms, needle_window)}

SQL = {
    "profile_usage_counts": """
        WITH d AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'COMPILED' WHEN 1 THEN 'SOURCE' WHEN 2 THEN 'PROJECT' WHEN 3 THEN 'CONTEXT_PACK' ELSE 'RESOURCE' END AS layer,
                          CASE WHEN toxic = 1 THEN 'DISPUTED' ELSE 'ACTIVE' END AS lifecycle,
                          CASE WHEN doc_id % 23 = 0 THEN 'STALE_BLOCKED' WHEN doc_id % 17 = 0 THEN 'STALE_PENDING_REVIEW' ELSE 'FRESH' END AS freshness
                   FROM documents LEFT JOIN labels USING (doc_id))
        SELECT 'LAYER' AS kind, layer AS name, '' AS detail, count(*) AS n FROM d GROUP BY layer
        UNION ALL SELECT 'STATE', lifecycle, freshness, count(*) FROM d GROUP BY lifecycle, freshness
        UNION ALL SELECT 'RELATION', 'related_to', '', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey HAVING count(*) > 0
        UNION ALL SELECT 'RELATION', 'derives_from', '', count(*) FROM supplier HAVING count(*) > 0
        UNION ALL SELECT 'RELATION', 'supports', '', count(*) FROM customer HAVING count(*) > 0""",
    "graph_health_rollup": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
        SELECT c_mktsegment AS domain, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'F') AS stale,
               count(*) FILTER (WHERE o_orderstatus = 'P') AS building, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, max(o_orderdate) AS latest
        FROM customer LEFT JOIN (SELECT * FROM r WHERE k = 1) ON c_custkey = o_custkey GROUP BY 1""",
    "project_counts": """
        SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_nodes,
               (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n_edges,
               (SELECT max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'P') AS latest_error
        FROM nation""",
    "support_sets_containing": """
        SELECT p_partkey, count(*) AS n_sets, min(l_orderkey) AS first_set
        FROM part JOIN (SELECT l_orderkey, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1) ON list_contains(ids, p_partkey)
        WHERE p_size <= 2 GROUP BY 1""",
    "synthesis_candidates": """
        SELECT sha256(text) AS community, count(*) AS n_members, min(doc_id) AS lead
        FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1 AND text IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
    "revision_set_hash": """
        SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS set_hash FROM lineitem GROUP BY 1""",
    "recency_truncation": """
        SELECT * FROM (SELECT 'orders' AS origin, o_orderkey AS id, o_orderdate AS moment FROM orders UNION ALL SELECT 'events', event_id, ts FROM events)
        ORDER BY moment DESC, origin, id LIMIT 50""",
    "bounded_export": """
        SELECT p_partkey, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place, (SELECT count(*) FROM part) > 100 AS truncated
        FROM part QUALIFY place <= 100""",
    "best_row_per_key": """
        SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_discount = 0 DESC, l_orderkey, l_linenumber) = 1""",
    "work_claim_findings": """
        WITH c AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')
        SELECT 'ORPHAN_WORK' AS detector, o_orderpriority, count(*) AS n_claims, min(l_orderkey) AS first_work FROM c WHERE o_orderstatus = 'F' GROUP BY 2
        UNION ALL SELECT 'EXPIRED_CLAIM', o_orderpriority, count(*), min(l_orderkey) FROM c WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 2""",
    "acronym_terms": r"""
        WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z0-9]{2,7}$')) AS l FROM documents),
             u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM t)
        SELECT doc_id, array_to_string(l[1:3], ',') AS acronyms FROM u WHERE len(l) > 0""",
    "needle_window": """
        WITH t AS (SELECT doc_id, text, CAST(strpos(lower(text), 'license') AS INTEGER) AS place FROM documents), u AS (SELECT *, greatest(place - 40, 1) AS s FROM t WHERE place > 0)
        SELECT doc_id, place, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, 87) || CASE WHEN s + 86 < length(text) THEN '...' ELSE '' END AS excerpt FROM u""",
}
