"""Candidate retrieval, fusion and assembly over documents and benchmark queries.

A benchmark item is a query.  Channels: exact hits, the 30 best by cover density, of
these raw rows and context packs, the 20 documents whose units' hashed vectors are
nearest to the query's, and documents with the text of an exact or lexical hit.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, graph, lexical, retrieval, vectors
from ..operators.graph import cut, shared_dir
from ..sources import bind
from .chunks import PLAIN_UNITS
from .rules import link_resolution

SCOPES = [("src0", None), ("src1", "src1/en"), ("src2", "src2/fr"), ("src3", None), ("src4", "src4/de"), ("src5", None), ("src6", None), ("src7", "src7/en"), ("src8", None), ("src9", None), ("src10", None)]


def governed(spark, d):
    """Documents that scope, lifecycle and freshness permit."""
    scopes = spark.createDataFrame(SCOPES, "vault string, prefix string")  # fixed, a handful of rows
    return filters.lifecycle_freshness_filter(filters.scope_filter(bind.documents(spark, d), scopes))


#: Fixed value: the least trust of what a search returns.
LEAST_TRUST = "MACHINE_SUPPORTED"


def trusted(spark, d):
    """Governed documents of the least trust that a search asks for."""
    return filters.trust_filter(governed(spark, d), LEAST_TRUST)


def lookups(spark, d):
    """What is looked up for each query: ids, aliases and abbreviations that have its
    number, and its own words."""
    b = bind.table(spark, d, "benchmark")
    n = F.col("item_id").cast("string")
    made = F.array(F.concat(F.lit("doc-"), n), F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"), F.lit("-"), n), F.concat(F.lit("what is D"), (F.col("item_id") + 1).cast("string"), F.lit("X")))
    return b.select(F.col("item_id").alias("query_id"), F.explode(made).alias("lookup")).unionByName(own_lookups(spark, d)).distinct()


def own_lookups(spark, d):
    b = bind.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.col("text"), text.first_line(F.col("text")))).alias("lookup")).distinct()


def questions(spark, d):
    return bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def terms(spark, d):
    return questions(spark, d).select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"))


_STORED: dict[tuple, str] = {}


def stored(spark, d, name, write):
    """The folder that ``write`` filled from the documents of ``d``; written once in a
    session for the same files, by name, size and time."""
    meta = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = bind.table(spark, d, "documents").select(meta.alias("f")).distinct().agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.to_json("f"))), ","))).first()[0]
    key = (spark.sparkContext.applicationId, files, name)
    if key in _STORED and not _there(spark, _STORED[key]):
        del _STORED[key]
    if key not in _STORED:
        path = f"{shared_dir(spark)}/tesserak-{uuid.uuid4().hex}/{name}"
        write(path)
        spark.range(1).write.parquet(path + "-done")
        _STORED[key] = path
    return _STORED[key]


def _there(spark, path):
    """Whether what was stored is still there: a policy may have cleared the folder."""
    try:
        return bool(spark.read.parquet(path + "-done").columns)
    except AnalysisException:
        return False


def lexical_index(spark, d):
    """The positional index over all documents and their units."""

    def write(path):
        lexical.Index(path).write(bind.identified(spark, d))  # a join with labels would shuffle all texts

    return lexical.Index(stored(spark, d, "lexical-index", write))


def unit_vectors(spark, d):
    """(doc_id, embedding) of every unit that is no container."""

    def write(path):
        atoms = bind.structural(spark, d).where("not container").select(F.col("doc_id").alias("id"), F.col("body").alias("text"))
        vectors.embedded(atoms).withColumnRenamed("id", "doc_id").write.parquet(path)

    return spark.read.parquet(stored(spark, d, "unit-vectors", write))


def scope_trust_filter(spark, d):
    return trusted(spark, d).select("doc_id", "path", "trust", "lifecycle", "freshness")


def mode_filter(spark, d):
    rows = filters.mode_filter(bind.documents(spark, d), "COMPILED_ONLY")
    return rows.groupBy("layer", "trust").agg(F.count("*").alias("n"))


def exact_lookup(spark, d):
    return retrieval.exact_lookup(governed(spark, d), lookups(spark, d))


def _lexical(spark, d, docs):
    return lexical.search(lexical_index(spark, d), questions(spark, d), docs.select("doc_id"), 30).drop("unit")


def lexical_search(spark, d):
    return _lexical(spark, d, governed(spark, d))


def vector_channel(spark, d):
    """(query_id, doc_id, score, rank): the 20 governed documents with the unit whose
    hashed vector is nearest to the query's, at an angle under 90 degrees."""
    return _vector(spark, d, governed(spark, d))


def _vector(spark, d, docs):
    held = unit_vectors(spark, d).join(docs.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "vec_id")
    asked = vectors.embedded(questions(spark, d).select(F.col("query_id").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "query_id")
    near = vectors.topk_batch(held, asked, 20).where("score > 0")
    return near.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def _channels(spark, d, docs=None):
    """Channels' rows (query_id, doc_id, channel, rank) over ``docs``: governed ones, if
    no others are given.  All channels see these alone, before they rank."""
    docs = governed(spark, d) if docs is None else docs
    # both results are small and used by several channels, so they are written once
    exact = cut(retrieval.ranked(retrieval.exact_lookup(docs, own_lookups(spark, d)), ["match_rank", "doc_id"], "exact"))
    found = cut(_lexical(spark, d, docs))
    lexical = retrieval.ranked(found, [F.desc("raw_score"), "doc_id"], "lexical")
    # digests are of all texts, and used for seeds and for their copies
    same = cut(docs.select("doc_id", "layer", F.col("digest").alias("hash")))
    layered = found.join(same.select("doc_id", "layer"), "doc_id")
    raw = retrieval.ranked(layered.where("layer in ('SOURCE', 'RESOURCE')"), [F.desc("raw_score"), "doc_id"], "raw")
    packs = retrieval.ranked(layered.where("layer = 'CONTEXT_PACK'"), [F.desc("raw_score"), "doc_id"], "context-pack")
    vector = _vector(spark, d, docs).select("query_id", "doc_id", F.lit("vector").alias("channel"), "rank")
    same = same.select("doc_id", "hash")
    seeds = exact.unionByName(lexical).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(same, "doc_id")
    near = seeds.select("query_id", "rank", "hash", F.col("doc_id").alias("seed")).join(same, "hash").where("doc_id <> seed")
    graph = retrieval.ranked(near.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best")), ["best", "doc_id"], "graph")
    out = exact
    for part in (lexical, raw, packs, vector, graph):
        out = out.unionByName(part)
    return out


def ppr_channel(spark, d):
    """(query_id, doc_id, score, rank): the 20 documents that links lead to most from a
    query's exact, lexical and vector hits, which are seeds by their fused ranks."""
    n = link_resolution(spark, d).where("to_doc is not null and doc_id <> to_doc")
    links = n.select(F.col("doc_id").alias("from_id"), F.col("to_doc").alias("to_id"), F.lit("links_to").alias("relation"), F.lit(1.0).alias("weight"))
    lexical_hits = retrieval.ranked(lexical_search(spark, d), [F.desc("raw_score"), "doc_id"], "lexical")
    near = vector_channel(spark, d).select("query_id", "doc_id", F.lit("vector").alias("channel"), "rank")
    exact = retrieval.ranked(retrieval.exact_lookup(governed(spark, d), own_lookups(spark, d)), ["match_rank", "doc_id"], "exact")
    fused = cut(retrieval.rrf_fuse(exact.unionByName(lexical_hits).unionByName(near)))
    score = graph.ppr_push(fused.select("query_id", F.col("doc_id").alias("seed"), F.col("score").alias("weight")), links)
    found = score.withColumnRenamed("node", "doc_id").join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(governed(spark, d).select("doc_id"), "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 20").select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


def rrf_fuse_rows(channels, limit):
    return retrieval.rrf_fuse(channels, limit=limit)


def hybrid_search_rrf(spark, d):
    """The 10 best documents of a query that scope, trust, lifecycle and freshness permit."""
    return retrieval.rrf_fuse(_channels(spark, d, trusted(spark, d)), limit=10)


def fused_hits(spark, d):
    """The hits of such a search whatever the trust of documents, for what is made of them."""
    return retrieval.rrf_fuse(_channels(spark, d), limit=10)


def rrf_fuse(spark, d):
    return retrieval.rrf_fuse(_channels(spark, d), weighted=False).select("query_id", "doc_id", "score", "rank")


def written_hits(spark, d):
    """fused_hits(), written: their size is then known to the planner, which needn't shuffle
    all texts to join them."""
    return cut(fused_hits(spark, d))


def _hits(spark, d):
    docs = bind.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    queries = bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return written_hits(spark, d).join(docs, "doc_id").join(queries, "query_id")


def lexical_rerank(spark, d):
    return retrieval.lexical_rerank(_hits(spark, d))


def passage_support(spark, d):
    return retrieval.passage_support(_hits(spark, d))


def _sections(spark, d):
    hits = written_hits(spark, d).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    units = bind.units(spark, d).select("doc_id", F.col("position").alias("section"), "tokens")
    return hits.join(units, "doc_id")


def diversity_interleave(spark, d):
    return retrieval.diversity_interleave(_sections(spark, d))


def pack_context_char4(spark, d):
    placed = cut(retrieval.diversity_interleave(_sections(spark, d)))
    tokens = bind.units(spark, d).select("doc_id", F.col("position").alias("section"), "tokens")
    return retrieval.pack_by_estimate(placed.join(tokens, ["doc_id", "section"]), 600)


DOCS = """docs as (
  select d.doc_id, d.source as vault, d.source || '/' || d.lang || '/' || cast(d.doc_id as varchar) || '.md' as path,
    'DOC-' || cast(d.doc_id as varchar) as external_id, split_part(d.text, chr(10), 1) as title, d.text as body,
    case when l.quality = 1 then 'HUMAN_REVIEWED' when l.quality = 0 then 'MACHINE_SUPPORTED' else 'UNVERIFIED' end as trust,
    case when l.toxic = 1 then 'DISPUTED' else 'ACTIVE' end as lifecycle,
    case when d.doc_id % 23 = 0 then 'STALE_BLOCKED' when d.doc_id % 17 = 0 then 'STALE_PENDING_REVIEW' else 'FRESH' end as freshness,
    case d.doc_id % 5 when 0 then 'COMPILED' when 1 then 'SOURCE' when 2 then 'PROJECT' when 3 then 'CONTEXT_PACK' else 'RESOURCE' end as layer
  from documents d left join labels l on d.doc_id = l.doc_id)"""
_VALUES = ", ".join(f"('{v}', {'null' if p is None else repr(p)})" for v, p in SCOPES)


def _governed(more: str = "") -> str:
    return f"""{DOCS},
scopes(vault, prefix) as (values {_VALUES}),
governed as (select * from docs where lifecycle in ('ACTIVE', 'DISPUTED') and freshness not in ('STALE_BLOCKED', 'INVALID'){more}
  and exists (select 1 from scopes s where s.vault = docs.vault and (s.prefix is null or docs.path = s.prefix or starts_with(docs.path, s.prefix || '/'))))"""


GOVERNED = _governed()
TRUSTED = _governed(" and trust in ('MACHINE_SUPPORTED', 'HUMAN_REVIEWED', 'ATTESTED')")


def _exact(name: str, source: str) -> str:
    return f"""{name} as (select query_id, doc_id, cast(min(match_rank) as integer) as match_rank from (
  select query_id, doc_id, 0 as match_rank from governed join {source} on lower(external_id) = lower(lookup)
  union all select query_id, doc_id, 1 from aliases join {source} on lower(alias) = lower(lookup)
  union all select query_id, doc_id, 2 from governed join {source} on lower(title) = lower(lookup)
  union all select query_id, doc_id, 3 from governed join {source} on lower(path) = lower(lookup)
  union all select query_id, min(doc_id), 4 from (select distinct query_id, lookup, doc_id from (select doc_id, lower(alias) as wanted from aliases union all select doc_id, lower(split_part(external_id, '-', -1)) from governed)
    join (select query_id, lookup, unnest(list_distinct(regexp_extract_all(lookup, '{retrieval.ACRONYM}'))[1:{retrieval.ACRONYMS}]) as acronym from {source} where regexp_matches(trim(lookup), '\\s')) on wanted = lower(acronym)) group by query_id, lookup having count(*) = 1) group by 1, 2)"""


EXACT = f"""own_lookups as (select item_id as query_id, text as lookup from benchmark union select item_id, split_part(text, chr(10), 1) from benchmark),
lookups as (select * from own_lookups union select item_id, unnest(['doc-' || item_id, 'SRC' || (item_id % 20) || '-' || item_id, 'what is D' || (item_id + 1) || 'X']) from benchmark),
aliases as (select doc_id, unnest([vault || '-' || doc_id, 'D' || doc_id || 'X']) as alias from governed),
{_exact("exact", "lookups")},
{_exact("own_exact", "own_lookups")}"""
_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


def _symbols(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"trim(lower(regexp_replace({out}, '[^A-Za-z0-9]+', ' ', 'g')))"


def _words(x: str, weight: float = lexical.CLASS_WEIGHT["D"]) -> str:
    """Words in order, each with the inverse of its weight."""
    return rf"list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: struct_pack(t := t, i := {1 / weight}::double))"


def _held(owner: str, unit: str, source: str, fields: dict[str, str]) -> str:
    """Rows (doc_id, unit, field, ws) of each field, and of the symbols of all."""
    parts = [f"select {owner}, {unit}, '{f}' as field, {_words(x)} as ws from {source}" for f, x in fields.items()]
    symbols = ", ".join(_words(_symbols(x), lexical.CLASS_WEIGHT[lexical.SYMBOL_CLASS[f]]) for f, x in fields.items())
    return " union all ".join([*parts, f"select {owner}, {unit}, 'symbol', flatten([{symbols}]) from {source}"])


def _ranked(fields: dict[str, float]) -> str:
    return " + ".join(f"{w}::double * coalesce(max(rank) filter (field = '{f}'), 0)" for f, w in fields.items())


_OWN = {"external_id": "external_id", "alias": "vault || '-' || doc_id || ' D' || doc_id || 'X'", "title": "title", "path": "path", "body": "body"}
_INNER = {"heading": "array_to_string(path, ' ')", "unit": "unit_key || ' ' || unit_type", "text": "body"}
_REASON = " ".join(f"when {test} then '{lexical.REASONS[f]}'" for f, test in (
    *((f, f"list_contains(own, '{f}')") for f in ("external_id", "alias", "path", "title")), ("symbol", "list_contains(own, 'symbol') and not plain"), ("heading", "list_contains(best.fields, 'heading')"),
    ("unit", "list_contains(best.fields, 'unit')"), ("symbol", "list_contains(best.fields, 'symbol')")))
#: Matches by sets of terms; then, in the matches' fields that hold all terms, places of
#: terms, the start of the least stretch that ends at each, and the sum over stretches.
LEXICAL = f"""{PLAIN_UNITS},
asked as (select item_id as query_id, false as symbol, {_TOKENS.format("text")} as terms from benchmark union all select item_id, true, {_TOKENS.format(_symbols("text"))} from benchmark),
held as ({_held("doc_id", "-1 as unit", "governed", _OWN)} union all {_held("doc_id", "structural_order", "(select u.* from units u join governed using (doc_id) where structural_order > 0)", _INNER)}),
bag as (select doc_id, unit, field = 'symbol' as symbol, list_distinct(flatten(list(list_transform(ws, lambda w: w.t)))) as ts from held group by 1, 2, 3),
lead as (select query_id, symbol, terms, list_sort(list_transform(terms, lambda t: struct_pack(n := -length(t), t := t)))[1].t as term from asked where len(terms) > 0),
matched as (select query_id, b.symbol, doc_id, unit, terms from (select doc_id, unit, symbol, ts, unnest(ts) as term from bag) b join lead l on b.term = l.term and b.symbol = l.symbol where list_has_all(ts, terms)),
field as (select query_id, doc_id, unit, field, terms, ws from matched m join held h using (doc_id, unit) where (field = 'symbol') = symbol and list_has_all(list_transform(ws, lambda w: w.t), terms)),
spot as (select query_id, doc_id, unit, field, len(terms) as m, unnest(list_filter(list_transform(ws, lambda w, p: struct_pack(p := p, t := w.t, i := w.i)), lambda w: list_contains(terms, w.t))) as s from field),
place as (select query_id, doc_id, unit, field, m, s.p as p, s.t as t, s.i as i, row_number() over w as at, sum(s.i) over w as total from spot window w as (partition by query_id, doc_id, unit, field order by s.p)),
final as (select e.query_id, e.doc_id, e.unit, e.field, e.p, x.t, max(x.p) as p2 from place e join place x on x.query_id = e.query_id and x.doc_id = e.doc_id and x.unit = e.unit and x.field = e.field and x.p <= e.p group by all),
stretch as (select query_id, doc_id, unit, field, p, min(p2) as start, count(*) as met from final group by all),
least as (select *, lag(start, 1, 0) over (partition by query_id, doc_id, unit, field order by p) as before from (select s.* from stretch s join (select distinct query_id, doc_id, unit, field, m from place) using (query_id, doc_id, unit, field) where met = m)),
density as (select l.query_id, l.doc_id, l.unit, l.field, sum(((e.at - b.at + 1) / (e.total - b.total + b.i)) / (1 + (l.p - l.start) - (e.at - b.at))) as rank
  from least l join place e on e.query_id = l.query_id and e.doc_id = l.doc_id and e.unit = l.unit and e.field = l.field and e.p = l.p join place b on b.query_id = l.query_id and b.doc_id = l.doc_id and b.unit = l.unit and b.field = l.field and b.p = l.start where l.start > l.before group by all),
whole as (select query_id, doc_id, 0 as unit, unnest(['heading', 'text']) as field, unnest(['title', 'body']) as own from matched m where unit = -1 and not symbol
  and list_has_all(list_transform((select flatten(list(ws)) from held h where h.doc_id = m.doc_id and h.unit = -1 and h.field in ('title', 'body')), lambda w: w.t), terms)),
unit_ranks as (select query_id, doc_id, unit, field, rank from density union all select w.query_id, w.doc_id, 0, w.field, rank from whole w join density d on d.query_id = w.query_id and d.doc_id = w.doc_id and d.unit = -1 and d.field = w.own),
inner_ as (select s.query_id, s.doc_id, s.unit, {_ranked(lexical.UNIT)} + case when not bool_or(coalesce(m.unit is not null, false)) then {lexical.SYMBOL["unit"]}::double * coalesce(max(rank) filter (field = 'symbol'), 0) else 0 end as score, list(distinct field) as fields
  from unit_ranks s left join (select query_id, doc_id, unit from matched where not symbol union select query_id, doc_id, 0 from whole) m on m.query_id = s.query_id and m.doc_id = s.doc_id and m.unit = s.unit where s.unit >= 0 group by 1, 2, 3),
best as (select query_id, i.doc_id, arg_min(struct_pack(fields := fields, score := score), struct_pack(s := -round(score, 9), c := container, u := unit)) as b from inner_ i join units u on u.doc_id = i.doc_id and u.structural_order = i.unit where score > 0 group by 1, 2),
hit_docs as (select query_id, doc_id, bool_or(unit = -1 and not symbol) as plain from matched group by 1, 2),
outer_ as (select f.query_id, f.doc_id, any_value(f.plain) as plain, {_ranked(lexical.DOCUMENT)} + case when not any_value(f.plain) then {lexical.SYMBOL["document"]}::double * coalesce(max(rank) filter (field = 'symbol'), 0) else 0 end as score, coalesce(list(distinct field) filter (field is not null), []) as own
  from hit_docs f left join density d on d.query_id = f.query_id and d.doc_id = f.doc_id and d.unit = -1 group by 1, 2),
lexical as (select query_id, doc_id, raw_score, reason from (select *, row_number() over (partition by query_id order by raw_score desc, doc_id) as place from (
  select o.query_id, o.doc_id, round(o.score + coalesce(best.score, 0), 6) as raw_score, case {_REASON} else '{lexical.REASONS["body"]}' end as reason
  from outer_ o left join (select query_id, doc_id, b.fields as fields, b.score as score from best) best on best.query_id = o.query_id and best.doc_id = o.doc_id)) where place <= 30)"""


def _hashed(key: str, source: str, column: str) -> str:
    return f"select {key}, unnest(regexp_extract_all(lower(strip_accents({column})), '[\\p{{L}}\\p{{N}}_-]+')) as t from {source}"


VECTOR = f"""unit_words as ({_hashed("doc_id, structural_order as unit", "units join governed using (doc_id) where not container", "units.body")}),
asked_words as ({_hashed("item_id as query_id", "benchmark", "text")}),
hash as (select t, cast('0x' || substring(sha256(t), 1, 4) as int) % 64 as idx, 1 - 2 * (cast('0x' || substring(sha256(t), 5, 2) as int) % 2) as sign from (select t from unit_words union select t from asked_words)),
unit_sums as (select doc_id, unit, idx, sum(sign) as v from unit_words join hash using (t) group by all), asked_sums as (select query_id, idx, sum(sign) as v from asked_words join hash using (t) group by all),
unit_norm as (select doc_id, unit, sum(v * v) as n from unit_sums group by all having sum(v * v) > 0), asked_norm as (select query_id, sum(v * v) as n from asked_sums group by all having sum(v * v) > 0),
dots as (select query_id, doc_id, unit, sum(a.v * u.v) as dot from asked_sums a join unit_sums u using (idx) group by all),
vector as (select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
  select query_id, doc_id, max(round(dot::double / sqrt((a.n * u.n)::double), 9)) as score from dots join unit_norm u using (doc_id, unit) join asked_norm a using (query_id) group by 1, 2)) where rank <= 20 and score > 0)"""


def _fused(weighted: bool) -> str:
    weight = "case channel when 'exact' then 3.0::double when 'context-pack' then 2.5 when 'lexical' then 1.5 when 'graph' then 1.4 when 'raw' then 1.2 else 1.0 end" if weighted else "1.0::double"
    return f"""x as (select query_id, doc_id, 'exact' as channel, row_number() over (partition by query_id order by match_rank, doc_id) as rank from own_exact
  union all select query_id, doc_id, 'lexical', row_number() over (partition by query_id order by raw_score desc, doc_id) from lexical),
same as (select doc_id, sha256(body) as hash, layer from governed),
seeds as (select query_id, x.doc_id as seed, min(rank) as rank, any_value(hash) as hash from x join same using (doc_id) group by 1, 2),
near as (select query_id, s.doc_id, min(rank) as best from seeds join same s using (hash) where s.doc_id <> seed group by 1, 2),
channels as (select * from x
  union all select query_id, doc_id, 'raw', row_number() over (partition by query_id order by raw_score desc, doc_id) from lexical join same using (doc_id) where layer in ('SOURCE', 'RESOURCE')
  union all select query_id, doc_id, 'context-pack', row_number() over (partition by query_id order by raw_score desc, doc_id) from lexical join same using (doc_id) where layer = 'CONTEXT_PACK'
  union all select query_id, doc_id, 'vector', rank from vector
  union all select query_id, doc_id, 'graph', row_number() over (partition by query_id order by best, doc_id) from near),
fused as (select query_id, doc_id, round(sum({weight} / (60 + rank) order by channel), 8) as score, string_agg(channel, ',' order by channel) as channels from channels group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused)"""


BASE = f"{GOVERNED},\n{EXACT},\n{LEXICAL},\n{VECTOR}"
HYBRID = f"{BASE},\n{_fused(True)}"
SECTIONS = """line_units as (select doc_id, unnest(generate_series(0, len(l) - 1)) as section, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents)),
sections as (select r.query_id, r.doc_id, r.rank as doc_rank, u.section, cast(ceil(length(u.content) / 4.0) as bigint) as tokens from ranked r join line_units u using (doc_id) where r.rank <= 10 and trim(u.content) <> ''),
turns as (select *, row_number() over (partition by query_id, doc_id order by section) as turn from sections),
placed as (select *, row_number() over (partition by query_id order by turn, doc_rank, doc_id) as place from turns where turn <= 3)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _salient(column: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 3 and not list_contains([{_STOP}], t)))"


QUERIES = {f.__name__: f for f in (ppr_channel, hybrid_search_rrf, exact_lookup, lexical_search, vector_channel, scope_trust_filter, mode_filter, rrf_fuse, lexical_rerank, passage_support, diversity_interleave, pack_context_char4)}

SQL = {
    "hybrid_search_rrf": f"with recursive {TRUSTED}, {EXACT}, {LEXICAL}, {VECTOR}, {_fused(True)} select query_id, doc_id, score, channels, rank from ranked where rank <= 10",
    "exact_lookup": f"with recursive {GOVERNED}, {EXACT} select query_id, doc_id, match_rank from exact",
    "lexical_search": f"with recursive {GOVERNED}, {LEXICAL} select query_id, doc_id, raw_score, reason from lexical",
    "vector_channel": f"with recursive {GOVERNED}, {PLAIN_UNITS}, {VECTOR} select query_id, doc_id, score, rank from vector",
    "scope_trust_filter": f"with recursive {GOVERNED} select doc_id, path, trust, lifecycle, freshness from governed where trust in ('MACHINE_SUPPORTED', 'HUMAN_REVIEWED', 'ATTESTED')",
    "mode_filter": f"with recursive {DOCS} select layer, trust, count(*) as n from docs where layer in ('COMPILED', 'PROJECT', 'CONTEXT_PACK') group by 1, 2",
    "rrf_fuse": f"with recursive {BASE}, {_fused(False)} select query_id, doc_id, score, rank from ranked",
    "lexical_rerank": rf"""with recursive {HYBRID},
      hit as (select r.query_id, r.doc_id, r.score, r.rank, lower(d.text) as content, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 3)) as terms
        from ranked r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10),
      flat as (select query_id, doc_id, score, rank, content, unnest(terms) as term from hit),
      added as (select query_id, doc_id, rank, round(any_value(score) + 0.001 * count(*) filter (contains(content, term)), 8) as score from flat group by 1, 2, 3)
      select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, rank, doc_id) as new_rank from added""",
    "passage_support": f"""with recursive {HYBRID},
      hit as (select r.query_id, r.doc_id, {_salient("b.text")} as want, {_salient("d.text")} as have from ranked r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10),
      n as (select query_id, doc_id, len(want) as n, len(list_intersect(want, have)) as overlap from hit)
      select query_id, doc_id, cast(overlap as bigint) as overlap, round(overlap / greatest(n, 1)::double, 6) as coverage, n > 0 and overlap >= least(2, greatest(n, 1)) and overlap / greatest(n, 1)::double >= 0.4 as supported from n""",
    "diversity_interleave": f"with recursive {HYBRID}, {SECTIONS} select query_id, doc_id, section, turn, place from placed",
    "pack_context_char4": f"""with recursive {HYBRID}, {SECTIONS}, used as (select *, cast(sum(tokens) over (partition by query_id order by place) as bigint) as used from placed)
      select query_id, place, doc_id, section, tokens, used from used where used <= 600""",
}
