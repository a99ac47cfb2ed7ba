"""Code graph: two commits of made symbols over ``part``, edges over ``lineitem``.

A part is a symbol; the second commit moves, renames, edits, drops and adds some.
Consecutive lines of an order join their parts by an edge.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import codegraph
from ..sources import bind

KINDS = ["CLASS", "FUNCTION", "TYPE"]
RELATIONS = ["calls", "imports", "references", "tests", "contains"]


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def symbols(spark, d):
    """The first commit."""
    p = bind.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("symbol_id"),
        F.concat(F.lit("repo"), (k % 3).cast("string")).alias("repo"),
        _pick(KINDS, "p_partkey").alias("kind"),
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".ts")).alias("path"),
        F.concat(F.lit("sym"), k.cast("string")).alias("name"),
        F.concat_ws(".", "p_type", F.col("p_name"), (k % 40).cast("string")).alias("qualified_name"),
        F.concat(F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit(")"), (k % 25).cast("string")).alias("signature"),
        (k * 7 % 500).alias("line"),
        F.sha2(F.concat_ws("|", "p_name", F.col("p_retailprice").cast("decimal(12,2)").cast("string")), 256).alias("hash"),
    )


def new_symbols(spark, d):
    """The second commit: every 11th moved, 13th renamed, 19th edited, 23rd gone, 29th added."""
    old = symbols(spark, d)
    k = F.col("symbol_id")
    kept = old.where(k % 23 != 0).select(
        (k + 1_000_000_000).alias("symbol_id"),
        "repo",
        "kind",
        F.when(k % 11 == 0, F.concat(F.lit("lib/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when(k % 13 == 0, F.concat(F.col("name"), F.lit("X"))).otherwise(F.col("name")).alias("name"),
        F.when(k % 17 == 0, F.concat(F.lit("v2."), F.col("qualified_name"))).otherwise(F.col("qualified_name")).alias("qualified_name"),
        F.when(k % 31 == 0, F.concat(F.col("signature"), F.lit("?"))).otherwise(F.col("signature")).alias("signature"),
        "line",
        F.when(k % 19 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"),
    )
    added = old.where(k % 29 == 0).select((k + 2_000_000_000).alias("symbol_id"), "repo", "kind", "path", F.concat(F.lit("new"), F.col("name")).alias("name"), F.concat(F.lit("new."), F.col("qualified_name")).alias("qualified_name"), F.concat(F.lit("new"), F.col("signature")).alias("signature"), (F.col("line") + 1000).alias("line"), F.sha2(F.concat(F.lit("new"), F.col("hash")), 256).alias("hash"))
    return kept.unionByName(added)


def edges(spark, d):
    """(from_id, to_id, relation) between the parts of consecutive lines of an order."""
    line = bind.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = line.withColumn("to_id", F.lead("l_partkey").over(w)).where("to_id is not null and to_id <> l_partkey")
    return rows.select(F.col("l_partkey").alias("from_id"), "to_id", _pick(RELATIONS, "l_suppkey").alias("relation")).distinct()


def _seeds(spark, d, every):
    return bind.table(spark, d, "part").where(F.col("p_partkey") % every == 0).select(F.col("p_partkey").alias("seed"))


def commit_delta(spark, d):
    return codegraph.commit_delta(symbols(spark, d), new_symbols(spark, d)).groupBy("kind", "change").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("path").alias("last_path"))


def symbol_reconciliation(spark, d):
    return codegraph.reconcile(symbols(spark, d), new_symbols(spark, d))


def code_symbol(spark, d):
    """Symbols by kind, repository and a part of their payload; at most 100, by id."""
    rows = symbols(spark, d).where("kind = 'FUNCTION' and repo = 'repo1' and contains(path, 'brand#1') = false and line < 250")
    return rows.orderBy("symbol_id").limit(100).select("symbol_id", "path", "name")


def code_callers(spark, d):
    return codegraph.one_hop(_seeds(spark, d, 20), edges(spark, d), codegraph.CALLS, True)


def code_callees(spark, d):
    return codegraph.one_hop(_seeds(spark, d, 20), edges(spark, d), codegraph.CALLS, False)


def code_dependencies(spark, d):
    return codegraph.one_hop(_seeds(spark, d, 20), edges(spark, d), codegraph.DEPENDENCIES, False)


def code_tests(spark, d):
    return codegraph.one_hop(_seeds(spark, d, 20), edges(spark, d), ["tests"], True)


def code_path(spark, d):
    return codegraph.reach(_seeds(spark, d, 200), edges(spark, d), codegraph.STEPS, 3)


def code_explain(spark, d):
    """Each symbol's neighbourhood in numbers: edges out, edges in, relations that it has."""
    e = edges(spark, d)
    ends = e.select(F.col("from_id").alias("symbol_id"), "relation", F.lit(1).alias("out")).unionByName(e.select(F.col("to_id").alias("symbol_id"), "relation", F.lit(0).alias("out")))
    near = ends.groupBy("symbol_id").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))
    return symbols(spark, d).select("symbol_id", "path", "kind").join(near, "symbol_id", "left").select("symbol_id", "path", "kind", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("relations", F.lit("")).alias("relations"))


def impact_partitions(spark, d):
    """What a change of every 400th symbol reaches both ways in two hops, by class."""
    seeds = _seeds(spark, d, 400)
    near = codegraph.reach(seeds, edges(spark, d), [*codegraph.STEPS], 2, both_ways=True).select("node", "hops").unionByName(seeds.select(F.col("seed").alias("node"), F.lit(0).cast("long").alias("hops")))
    rows = near.groupBy("node").agg(F.min("hops").alias("hops")).select(
        "node",
        "hops",
        F.when(F.col("node") % 10 == 3, "EPISTEMIC").when(F.col("node") % 10 == 4, "WORK").when(F.col("node") % 10 == 5, "RUNTIME").otherwise("CODE").alias("domain"),
        (F.col("node") % 7 == 0).alias("is_test"),
        (F.col("node") % 4 / F.lit(3.0)).alias("confidence"),
    )
    return codegraph.impact_partitions(rows).select("node", "hops", "part")


def coverage_links(spark, d):
    """Functions that ran, from the lines of returned items, matched to symbols."""
    line = bind.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    path = F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".ts"))
    part = bind.table(spark, d, "part").select("p_partkey", path.alias("path"))
    runs = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("path", F.concat(F.lit("f"), (F.col("p_partkey") % 90).cast("string")).alias("function"), F.col("l_linenumber").cast("long").alias("count"))
    nodes = symbols(spark, d).where("symbol_id % 3 <> 1").select(F.col("symbol_id").alias("node_id"), "path", F.concat(F.lit("f"), (F.col("symbol_id") % 90).cast("string")).alias("name"))
    return codegraph.coverage_links(runs, nodes)


def tier_transition(spark, d):
    e = edges(spark, d).groupBy("from_id").agg(F.count("*").alias("n"))
    tier = lambda c: _pick(codegraph.TIERS, c)
    own = e.select(F.col("from_id").alias("edge_id"), tier("from_id").alias("tier"))
    line = bind.table(spark, d, "lineitem")
    seen = line.where("l_linenumber <= 2").select(F.col("l_partkey").alias("edge_id"), tier("l_suppkey").alias("tier"))
    return codegraph.tier_transitions(own, seen)


QUERIES = {f.__name__: f for f in (commit_delta, symbol_reconciliation, code_symbol, code_callers, code_callees, code_dependencies, code_tests, code_path, code_explain, impact_partitions, coverage_links, tier_transition)}

_KIND = "case {0} % 3 when 0 then 'CLASS' when 1 then 'FUNCTION' else 'TYPE' end"
SYMBOLS = f"""old as (select p_partkey as symbol_id, 'repo' || (p_partkey % 3) as repo, {_KIND.format('p_partkey')} as kind, 'src/' || lower(replace(p_brand, '#', '')) || '.ts' as path, 'sym' || p_partkey as name,
    p_type || '.' || p_name || '.' || (p_partkey % 40) as qualified_name, p_name || '(' || p_size || ')' || (p_partkey % 25) as signature, p_partkey * 7 % 500 as line, sha256(p_name || '|' || cast(cast(p_retailprice as decimal(12,2)) as varchar)) as hash from part),
  new as (select symbol_id + 1000000000 as symbol_id, repo, kind, case when symbol_id % 11 = 0 then 'lib/' || path else path end as path, case when symbol_id % 13 = 0 then name || 'X' else name end as name,
      case when symbol_id % 17 = 0 then 'v2.' || qualified_name else qualified_name end as qualified_name, case when symbol_id % 31 = 0 then signature || '?' else signature end as signature, line, case when symbol_id % 19 = 0 then sha256(hash) else hash end as hash from old where symbol_id % 23 <> 0
    union all select symbol_id + 2000000000, repo, kind, path, 'new' || name, 'new.' || qualified_name, 'new' || signature, line + 1000, sha256('new' || hash) from old where symbol_id % 29 = 0)"""
EDGES = """edges as (select distinct l_partkey as from_id, to_id, case l_suppkey % 5 when 0 then 'calls' when 1 then 'imports' when 2 then 'references' when 3 then 'tests' else 'contains' end as relation
  from (select *, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as to_id from lineitem) where to_id is not null and to_id <> l_partkey)"""


def _hop(relations: list[str], incoming: bool) -> str:
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    names = ", ".join(f"'{r}'" for r in relations)
    return f"with {EDGES} select distinct {here} as seed, {there} as node, relation from edges where relation in ({names}) and {here} % 20 = 0 and from_id <> to_id"


def _levels(every: int, hops: int, source: str) -> str:
    out = f"l0 as (select p_partkey as seed, p_partkey as node, 0::bigint as hops from part where p_partkey % {every} = 0)"
    for h in range(1, hops + 1):
        out += f", l{h} as materialized (select distinct l.seed, e.dst as node, {h}::bigint as hops from l{h - 1} l join {source} e on e.src = l.node)"
    return out + ", walked as (select seed, node, min(hops) as hops from (" + " union all ".join(f"select * from l{h}" for h in range(hops + 1)) + ") group by 1, 2)"


SQL = {
    "commit_delta": f"""with {SYMBOLS}, b as (select coalesce(o.repo, n.repo) as repo, coalesce(o.path, n.path) as path, coalesce(o.kind, n.kind) as kind, coalesce(o.name, n.name) as name, o.hash as was, n.hash as now from old o full join new n on o.repo = n.repo and o.path = n.path and o.kind = n.kind and o.name = n.name),
      t as (select distinct repo, path from b where was is distinct from now), c as (select b.*, case when was is null then 'ADDED' when now is null then 'REMOVED' else 'CHANGED' end as change from b join t using (repo, path))
      select kind, change, count(*) as n, min(name) as first_name, max(path) as last_path from c group by 1, 2""",
    "symbol_reconciliation": f"""with {SYMBOLS}, m as (select o.symbol_id as old_id, n.symbol_id as new_id, o.path <> n.path as moved, o.name <> n.name as renamed, o.qualified_name <> n.qualified_name as requalified, o.signature = n.signature as s, o.qualified_name = n.qualified_name as q, o.name = n.name as m, o.hash = n.hash as h, o.line = n.line as l
        from old o join new n on o.repo = n.repo and o.kind = n.kind where (o.path <> n.path or o.name <> n.name or o.qualified_name <> n.qualified_name)),
      a as (select *, s::int * 100 + q::int * 80 + m::int * 50 + h::int * 40 + l::int * 20 as score from m where case when moved then s or q or m else s or l end),
      t as (select *, max(score) over (partition by new_id) as best from a), k as (select *, count(*) over (partition by new_id) as n from t where score = best)
      select old_id, new_id, case when moved and renamed then 'MOVED_AND_RENAMED_FROM' when moved then 'MOVED_FROM' else 'RENAMED_FROM' end as relationship, case when n > 1 then 'AMBIGUOUS' else 'CANDIDATE' end as state, score,
        case when s and h then 0.98::double when q and h then 0.94 when m and h then 0.9 when s then 0.84 when q then 0.78 when m then 0.64 else 0.45 end as confidence from k""",
    "code_symbol": f"with {SYMBOLS} select symbol_id, path, name from old where kind = 'FUNCTION' and repo = 'repo1' and not contains(path, 'brand#1') and line < 250 order by symbol_id limit 100",
    "code_callers": _hop(codegraph.CALLS, True),
    "code_callees": _hop(codegraph.CALLS, False),
    "code_dependencies": _hop(codegraph.DEPENDENCIES, False),
    "code_tests": _hop(["tests"], True),
    "code_path": f"with {EDGES}, e as (select distinct from_id as src, to_id as dst from edges), {_levels(200, 3, 'e')} select seed, node, hops from walked where hops > 0",
    "code_explain": f"""with {SYMBOLS}, {EDGES}, ends as (select from_id as symbol_id, relation, 1 as o from edges union all select to_id, relation, 0 from edges),
      near as (select symbol_id, cast(sum(o) as bigint) as n_out, cast(sum(1 - o) as bigint) as n_in, string_agg(distinct relation, ',' order by relation) as relations from ends group by 1)
      select symbol_id, path, kind, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, coalesce(relations, '') as relations from old left join near using (symbol_id)""",
    "impact_partitions": f"""with {EDGES}, e as (select from_id as src, to_id as dst from edges union select to_id, from_id from edges), {_levels(400, 2, 'e')}, near as (select node, min(hops) as hops from walked group by 1)
      select node, hops, case when hops = 0 then 'CHANGED' when node % 7 = 0 then 'TESTS' when node % 4 / 3.0 < 0.5 then 'UNCERTAIN' when node % 10 not in (3, 4, 5) and hops = 1 then 'DIRECT_CODE' when node % 10 not in (3, 4, 5) then 'TRANSITIVE_CODE' when node % 10 = 3 then 'KNOWLEDGE' when node % 10 = 4 then 'WORK' else 'OTHER' end as part from near""",
    "coverage_links": f"""with {SYMBOLS}, runs as (select 'src/' || lower(replace(p_brand, '#', '')) || '.ts' as path, 'f' || (p_partkey % 90) as function, cast(sum(l_linenumber) as bigint) as executions from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1, 2),
      nodes as (select path, 'f' || (symbol_id % 90) as function, count(*) as n, min(symbol_id) as node_id from old where symbol_id % 3 <> 1 group by 1, 2)
      select path, function, executions, case when n = 1 then node_id end as node_id, case when n is null then 'MISSING' when n > 1 then 'AMBIGUOUS' else 'LINKED' end as status from runs left join nodes using (path, function)""",
    "tier_transition": f"""with {EDGES}, own as (select distinct from_id as edge_id, from_id % 4 as t from edges), seen as (select l_partkey as edge_id, max(l_suppkey % 4) as t from lineitem where l_linenumber <= 2 group by 1)
      select edge_id, ['INFERRED', 'STATIC', 'RUNTIME_OBSERVED', 'DYNAMICALLY_PROVEN'][own.t + 1] as was, ['INFERRED', 'STATIC', 'RUNTIME_OBSERVED', 'DYNAMICALLY_PROVEN'][seen.t + 1] as now from own join seen using (edge_id) where seen.t > own.t""",
}
