"""What becomes of retrieved hits: support, answerability, order, disclosure, fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cues, planning, text
from ..operators import packets
from ..operators import retrieval as op
from ..operators.graph import cut
from ..sources import bind
from . import retrieval
from .retrieval import HYBRID, _salient


def _queries(spark, d):
    return bind.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _reasons(spark, d):
    hits = retrieval.written_hits(spark, d)
    docs = bind.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    support = op.passage_support(hits.join(docs, "doc_id").join(_queries(spark, d), "query_id"))
    return op.support_reasons(hits, support)


def match_reason(spark, d):
    """How often each reason explains a lexical hit, by layer."""
    layers = retrieval.governed(spark, d).select("doc_id", "layer")
    return retrieval.lexical_search(spark, d).join(layers, "doc_id").groupBy("layer", "reason").agg(F.count("*").alias("n"), F.max("raw_score").alias("best"))


def support_reasons(spark, d):
    return _reasons(spark, d)


def answerability(spark, d):
    return op.answerability(_queries(spark, d), _reasons(spark, d), retrieval.vector_channel(spark, d))


def partition_hits(spark, d):
    return op.partition_hits(_queries(spark, d), _reasons(spark, d))


def _met(hits):
    """The documents of hits, written: few, so texts are taken by them before they move."""
    return cut(hits.select("doc_id").distinct())


def _passages(spark, d, hits):
    """The unit of each hit that holds most of the query's salient words, the first such."""
    units = bind.structural(spark, d, among=_met(hits)).where("not container").select("doc_id", "structural_order", "start_line", F.col("body").alias("content"))
    rows = hits.select("query_id", "doc_id").join(units, "doc_id").join(_queries(spark, d), "query_id")
    shown = F.size(F.array_intersect(text.salient(F.col("query")), text.tokens(F.col("content"))))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("shown"), "structural_order")
    best = rows.withColumn("shown", shown).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("query_id", "doc_id", "start_line", "content", "shown")


def _candidates(spark, d):
    hits = cut(retrieval.fused_hits(spark, d).select("query_id", "doc_id", "score", "rank"))
    mandatory = F.col("layer") == "CONTEXT_PACK"
    docs = bind.documents(spark, d, among=_met(hits)).select("doc_id", "external_id", "title", "trust", "lifecycle", "freshness", "body", mandatory.alias("mandatory"))
    passages = _passages(spark, d, hits).select("query_id", "doc_id", "content")
    rows = hits.join(docs, "doc_id").join(passages, ["query_id", "doc_id"], "left")
    return cut(rows.withColumn("content", F.coalesce("content", "body")))


def candidate_order(spark, d):
    rows = _candidates(spark, d).select("query_id", "doc_id", "mandatory", F.when(F.col("rank") % 3 != 0, F.col("rank")).alias("rank"), "trust", "freshness", (F.col("doc_id") % 4).alias("citations"), "score")
    return op.candidate_order(rows)


def _disclosed(candidates, level):
    catalog = F.concat_ws("; ", *[F.concat(F.lit(n + "="), F.col(c)) for n, c in (("id", "external_id"), ("title", "title"), ("lifecycle", "lifecycle"), ("refresh", "freshness"))])
    rows = candidates.select("query_id", "doc_id", catalog.alias("catalog"), "content", F.col("body").alias("full"))
    return op.disclosed(rows, level)


def disclosure_levels(spark, d):
    """Tokens and a digest of each candidate at every level of disclosure."""
    out, candidates = None, _candidates(spark, d)
    for level in ("L0", "L1", "L2", "L3"):
        rows = _disclosed(candidates, level).select("query_id", "doc_id", "level", "tokens", F.sha2("content", 256).alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_term_window(spark, d):
    hits = retrieval.written_hits(spark, d).select("query_id", "doc_id")
    docs = bind.table(spark, d, "documents").select("doc_id", "text")
    rows = hits.join(docs, "doc_id").join(_queries(spark, d), "query_id")
    return rows.select("query_id", "doc_id", op.best_term_window(F.col("text"), text.salient(F.col("query"), 6)).alias("snippet"))


def evidence_fragment(spark, d):
    """The unit that shows most of a hit's query, in 2,000 characters at most, with its
    first line and digest; hits without a unit, or whose units show no word of it, have none."""
    best = _passages(spark, d, retrieval.written_hits(spark, d)).where("shown > 0")
    excerpt = F.trim(F.substring(F.trim("content"), 1, 2000))
    return best.select("query_id", "doc_id", F.col("start_line").alias("line"), F.length(excerpt).cast("long").alias("characters"), F.sha2(excerpt, 256).alias("digest"))


def parent_rehydration(spark, d):
    """Around each matching line of a lexical hit its document's lines from the one
    before to the one after: the parent's context of a unit."""
    hits = cut(retrieval.lexical_search(spark, d).select("query_id", "doc_id"))
    lines = bind.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    terms = retrieval.terms(spark, d)
    units = lines.join(hits, "doc_id").join(terms, "query_id")
    found = units.where(F.size(F.array_except("terms", text.tokens(F.col("content")))) == 0).select("query_id", "doc_id", "line")
    around = found.select("query_id", "doc_id", F.col("line").alias("unit"), F.explode(F.sequence(F.col("line") - 1, F.col("line") + 1)).alias("line"))
    met = cut(around).join(lines, ["doc_id", "line"])
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda r: r["content"]), "\n")
    return met.groupBy("query_id", "doc_id", "unit").agg(context.alias("context"), F.count("*").alias("lines"))


def projection_retains_support(spark, d):
    """Whether a hit's passage still holds the whole query, in any case."""
    rows = _candidates(spark, d).join(_queries(spark, d), "query_id")
    needle = F.lower(F.trim("query"))
    return rows.select("query_id", "doc_id", ((needle != "") & F.contains(F.lower("content"), needle)).alias("retained"))


def material_conflicts(spark, d):
    """Hits of one query that share a title but not a text: both sides, by id."""
    rows = _candidates(spark, d).select("query_id", "doc_id", text.normalize_identity(F.col("title")).alias("identity"), F.sha2("body", 256).alias("h")).where("identity <> ''")
    a, b = rows, rows.select("query_id", "identity", F.col("doc_id").alias("other"), F.col("h").alias("h2"))
    return a.join(b, ["query_id", "identity"]).where("doc_id < other and h <> h2").select("query_id", "doc_id", "other")


def pack_context(spark, d):
    """A full and a compact packet of each query's hits, under budgets on their exact size."""
    rows = _candidates(spark, d)
    cited = F.when(F.col("doc_id") % 4 > 0, F.array(F.concat(F.lit("cite-"), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    one = F.struct("doc_id", F.lit(None).cast("string").alias("unit"), "title", "content", "rank", "score", "mandatory", "trust", "freshness", cited.alias("citations"))
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    pairs = material_conflicts(spark, d).groupBy("query_id", F.col("doc_id").alias("first")).agg(F.array_sort(F.collect_set("other")).alias("others"))
    side = F.struct(F.concat(F.lit("conflict-"), F.col("first").cast("string")).alias("id"), F.concat(F.array("first"), F.col("others")).alias("documents"))
    clashes = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(side)).alias("conflicts"))
    asked = _queries(spark, d).join(found, "query_id", "left").join(clashes, "query_id", "left")
    return packets.pack_context(asked)


#: How questions begin, by the query's number; the sixth is a name to look up.
STARTS = ["how to avoid ", "why is ", "when must ", "what is ", "", "DOC-7 ", "compare ", "the rule of "]


def answer_cues(spark, d):
    """Whether each hit answers what its question asks for, by text, cues and vectors."""
    start = F.element_at(F.array(*map(F.lit, STARTS)), (F.col("query_id") % len(STARTS) + 1).cast("int"))
    asked = _queries(spark, d).select("query_id", F.trim(F.concat(start, F.when(F.col("query_id") % 8 != 5, F.col("query")).otherwise(""))).alias("query"))
    hits = retrieval.written_hits(spark, d).select("query_id", "doc_id")
    docs = bind.table(spark, d, "documents").select("doc_id", F.col("text").alias("passage"))
    near = retrieval.vector_channel(spark, d).select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    rows = hits.join(docs, "doc_id").join(asked, "query_id").join(near, ["query_id", "doc_id"], "left")
    rows = rows.withColumn("asked", cues.folded("query")).withColumn("held", cues.folded("passage"))
    rows = rows.withColumn("asked", cues.words(F.col("asked"))).withColumn("held", cues.words(F.col("held")))
    found = cues.signal(F.col("query"), F.col("asked"), F.col("passage"), F.col("held"), F.col("vector_rank"))
    return rows.select("query_id", "doc_id", *[c.alias(n) for n, c in found.items()])


#: What turns of a conversation are asked for, by number, and intents that are requested.
TASKS = ["What is ", "compare ", "impact of ", "workflow for ", "verify the source of ", "ADR-12 ", "global panorama of ", "repository code in OrderService.run ", "", "permission as of today: "]
REQUESTED = [None, "global_synthesis", None, "nonsense", "NO_RETRIEVAL_REQUIRED", None, None]


def plan_query(spark, d):
    """Intent, shapes, strategy and channels of every turn of the conversations."""
    t = bind.table(spark, d, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    bits = {"vector": 2, "graph": 3, "community": 5, "raw": 4, "code": 2, "context_pack": 3}
    rows = t.select("conv_id", "turn", F.concat(pick(TASKS), F.coalesce("text", F.lit(""))).alias("query"), pick(REQUESTED).alias("requested"), *[(k % n != 0).alias(name) for name, n in bits.items()])
    found = planning.plan(F.col("query"), F.col("requested"), F.col)
    return rows.select("conv_id", "turn", *[(F.array_join(c, ",") if n in ("shapes", "channels", "omitted") else c).alias(n) for n, c in found.items()])


QUERIES = {f.__name__: f for f in (answer_cues, plan_query, pack_context, match_reason, support_reasons, answerability, partition_hits, candidate_order, disclosure_levels, best_term_window, evidence_fragment, parent_rehydration, projection_retains_support, material_conflicts)}

REASONS = f"""{HYBRID}, hit as (select r.query_id, r.doc_id, r.rank, r.channels, {_salient("b.text")} as want, {_salient("d.text")} as have from ranked r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10),
  sup as (select *, len(want) as n, len(list_intersect(want, have)) as o from hit),
  reasons as (select query_id, doc_id, rank, case when list_has_any(string_split(channels, ','), ['exact', 'code', 'raw', 'context-pack', 'temporal']) then 'DIRECT_CHANNEL_SUPPORT' when n > 0 and o >= least(2, greatest(n, 1)) and o / greatest(n, 1)::double >= 0.4 then 'PASSAGE_TEXT_SUPPORT' else 'PASSAGE_SUPPORT_NOT_DEMONSTRATED' end as reason from sup)"""
PASSAGES = f"""{HYBRID}, passage as (select query_id, doc_id, content, start_line, shown from (select *, row_number() over (partition by query_id, doc_id order by shown desc, structural_order) as n from (
  select r.query_id, r.doc_id, u.body as content, u.start_line, u.structural_order, len(list_intersect({_salient("b.text")}, regexp_extract_all(lower(u.body), '[\\p{{L}}\\p{{N}}]+'))) as shown from ranked r join units u using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10 and not u.container)) where n = 1)"""
CANDIDATES = f"{PASSAGES}, cand as (select r.query_id, r.doc_id, r.score, r.rank, d.*exclude(doc_id), coalesce(p.content, d.body) as content from ranked r join docs d using (doc_id) left join passage p on p.query_id = r.query_id and p.doc_id = r.doc_id where r.rank <= 10)"
_LINE = "trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))"



def _held_cues(tokens: str, table: dict[str, str]) -> str:
    line = f"' ' || array_to_string({tokens}, ' ') || ' '"
    return "list_filter([" + ", ".join(f"case when regexp_matches({line}, '{cues.pattern(v)}') then '{k}' end" for k, v in table.items()) + "], lambda x: x is not null)"


def _in_order(x: str) -> str:
    """Distinct items of a list, each at its first place."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


_WORDS = lambda x: rf"list_filter(regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= {cues.LEAST})"
_STARTS = "[" + ", ".join(f"'{x}'" for x in STARTS) + "]"
CUES = f"""{HYBRID}, question as (select item_id as query_id, trim(({_STARTS})[item_id % {len(STARTS)} + 1] || case when item_id % 8 <> 5 then text else '' end) as query from benchmark),
  met as (select r.query_id, r.doc_id, q.query, d.text as passage, v.rank as vector_rank, {_WORDS("q.query")} as a, {_WORDS("d.text")} as h
    from ranked r join documents d using (doc_id) join question q using (query_id) left join vector v on v.query_id = r.query_id and v.doc_id = r.doc_id where r.rank <= 10),
  pair as (select *, {_in_order("a")} as asked, {_in_order("h")} as held, list_distinct(h) as bag from met),
  cue as (select *, case when regexp_matches(query, '{cues.NAME}') and (regexp_matches(query, '[0-9_:/.]') or (contains(query, '-') and query = upper(query))) then [] else {_held_cues("asked", cues.ASKED)} end as required, {_held_cues("held", cues.ANSWERED)} as answers,
    list_filter(asked, lambda t: length(t) >= 3 and not list_contains([{retrieval._STOP}], t)) as salient from pair),
  sums as (select *, list_filter(required, lambda x: list_contains(answers, x)) as matched, len(salient) as n, len(list_intersect(salient, bag)) as met from cue),
  ok as (select *, len(matched) = len(required) as answered, case when n > 0 then met / n::double else 0 end as share from sums)"""
_Q = "coalesce(q, '')"
_LINE_OF = r"' ' || array_to_string(regexp_extract_all(lower(q), '[\p{L}\p{N}]+'), ' ') || ' '"


def _shown(words: list[str], beginnings: bool = False) -> str:
    return f"regexp_matches({_LINE_OF}, '{planning.words_pattern(words, beginnings)}')"


def _shape(name: str) -> str:
    test = {"EXACT_IDENTIFIER": f"regexp_matches(q, '{planning.IDENTIFIER}')", "PERMISSION_SENSITIVE_FEDERATED": _shown(planning.ACCESS)}.get(name) or _shown(text.SHAPES[name])
    more = [f"intent = '{i}'" for i, s in planning.IMPLIED.items() if s == name] + ([f"regexp_matches(q, '{planning.CODE}')"] if name == "CODE_SYMBOL_OR_PATH" else [])
    return f"case when {' or '.join([test, *more])} then '{name}' end"


_PICK = lambda values: "([" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"])[(conv_id * 3 + turn) % {len(values)} + 1]"
PLAN = f"""turns as (select conv_id, turn, {_PICK(TASKS)} || coalesce(text, '') as q, upper({_PICK(REQUESTED)}) as asked, (conv_id * 3 + turn) as k from conversations),
  can as (select *, k % 2 <> 0 as vector, k % 3 <> 0 as graph, k % 5 <> 0 as community, k % 4 <> 0 as raw, k % 2 <> 0 as code, k % 3 <> 0 as context_pack from turns),
  i as (select *, case when asked in ({", ".join(f"'{x}'" for x in planning.CHANNELS)}) then asked {" ".join(f"when {_shown(w, n in planning.BEGINNINGS)} then '{n}'" for n, w in planning.INTENTS.items())} when regexp_matches(q, '{planning.IDENTIFIER}') then 'EXACT_LOOKUP' else 'CONCEPTUAL' end as intent from can),
  s as (select *, list_filter([{", ".join(_shape(n) for n in planning.shape_names())}], lambda x: x is not null) as shapes, case intent {" ".join(f"when '{n}' then {c}::varchar[]" for n, c in planning.CHANNELS.items())} end as listed from i),
  w as (select *, list_filter(listed, lambda c: not (c = 'vector' and not vector and intent in ('CONCEPTUAL', 'COMPARISON'))) as wanted, list_filter([{", ".join(f"case when not {n} then '{c}' end" for c, n in planning.NEEDS.items())}], lambda x: x is not null) as missing from s),
  c as (select *, list_filter(wanted, lambda c: not list_contains(missing, c)) as channels from w)"""

SQL = {
    "answer_cues": f"""with recursive {CUES}, r as (select *, case when trim(passage) = '' then 'NO_CONCRETE_PASSAGE' when n > 0 and met >= least({cues.OVERLAP}, greatest(n, 1)) and share >= {cues.COVERAGE} and answered then 'PASSAGE_TEXT_SUPPORT'
      when len(required) > 0 and answered and coalesce(vector_rank <= {cues.VECTOR_RANK}, false) then 'PASSAGE_CUE_SUPPORT' when not answered then 'ANSWER_CUE_MISMATCH' else 'PASSAGE_SUPPORT_NOT_DEMONSTRATED' end as reason from ok)
      select query_id, doc_id, reason in ('PASSAGE_TEXT_SUPPORT', 'PASSAGE_CUE_SUPPORT') as supported, reason, round(share, 6) as coverage, array_to_string(required, ',') as required, array_to_string(matched, ',') as matched from r""",
    "plan_query": f"""with {PLAN} select conv_id, turn, intent, array_to_string(shapes, ',') as shapes, case when intent = 'IMPACT_ANALYSIS' and graph then 'ASSOCIATIVE' when intent = 'GLOBAL_SYNTHESIS' and community then 'GLOBAL' when intent in ('CONCEPTUAL', 'COMPARISON') and community then 'DRIFT' else 'LOCAL' end as strategy,
      array_to_string(channels, ',') as channels, array_to_string(list_filter(wanted, lambda c: list_contains(missing, c)), ',') as omitted, case when not list_contains(channels, 'graph') then 0 when list_contains(shapes, 'MULTI_HOP') then 3 else 1 end as max_hops,
      intent = 'SOURCE_VERIFICATION' as require_evidence, case when list_contains(shapes, 'CORPUS_GLOBAL_SYNTHESIS') then 1 else 3 end as per_document from c""",
    "match_reason": f"with recursive {HYBRID} select layer, reason, count(*) as n, max(raw_score) as best from lexical join governed using (doc_id) group by 1, 2",
    "support_reasons": f"with recursive {REASONS} select query_id, doc_id, rank, reason, reason <> 'PASSAGE_SUPPORT_NOT_DEMONSTRATED' as supported from reasons",
    "answerability": f"""with recursive {REASONS}, k as (select query_id, count(*) as n, count(*) filter (reason <> 'PASSAGE_SUPPORT_NOT_DEMONSTRATED') as n_supported, bool_or(reason = 'DIRECT_CHANNEL_SUPPORT') as direct from reasons group by 1),
      v as (select query_id, max(score) filter (rank = 1) as s1, max(score) filter (rank = 2) as s2, max(score) filter (rank = 3) as s3 from vector group by 1)
      select b.item_id as query_id, coalesce(n_supported, 0) > 0 as supported, case when n is null then 'NO_CANDIDATES' when n_supported = 0 then 'SUPPORT_NOT_DEMONSTRATED' when direct then 'DIRECT_CHANNEL_SUPPORT' else 'PASSAGE_TEXT_SUPPORT' end as reason,
        coalesce(n_supported, 0) as n_supported, s1 as top_vector, round(s1 - s2, 6) as margin, round(s1 - coalesce(s3, s2, s1), 6) as neighbourhood from benchmark b left join k on k.query_id = b.item_id left join v on v.query_id = b.item_id""",
    "partition_hits": f"""with recursive {REASONS}, p as (select query_id, string_agg(doc_id, ',' order by rank) filter (reason <> 'PASSAGE_SUPPORT_NOT_DEMONSTRATED') as s, string_agg(doc_id, ',' order by rank) filter (reason = 'PASSAGE_SUPPORT_NOT_DEMONSTRATED') as e from reasons group by 1)
      select b.item_id as query_id, case when s is not null then 'SUPPORTED' when e is not null then 'EXPLORATORY_ONLY' else 'NO_CANDIDATES' end as outcome, coalesce(s, '') as supported, coalesce(e, '') as exploratory from benchmark b left join p on p.query_id = b.item_id""",
    "candidate_order": f"""with recursive {CANDIDATES} select query_id, doc_id, row_number() over (partition by query_id order by layer = 'CONTEXT_PACK' desc, case when rank % 3 <> 0 then rank end asc nulls last, case trust when 'ATTESTED' then 1 when 'HUMAN_REVIEWED' then 2 when 'MACHINE_SUPPORTED' then 3 else 4 end,
      case freshness when 'FRESH' then 1 when 'STALE_PENDING_REVIEW' then 2 else 3 end, doc_id % 4 desc, score desc, doc_id) as place from cand""",
    "disclosure_levels": f"""with recursive {CANDIDATES}, c as (select query_id, doc_id, 'id=' || external_id || '; title=' || title || '; lifecycle=' || lifecycle || '; refresh=' || freshness as catalog, content, body as f from cand),
      l as (select *, {_LINE} as flat from c), h as (select *, substring(flat, 1, 320) as head from l), e as (select *, 320 - case when length(head) < 320 then 320 - length(head) else 0 end - instr(reverse(head), ' ') as last, instr(head, ' ') > 0 as blank from h),
      o as (select *, case when length(flat) <= 320 then flat else rtrim(substring(flat, 1, case when blank and last >= 192 then last else 319 end)) || '…' end as line from e),
      a as (select query_id, doc_id, unnest(['L0', 'L1', 'L2', 'L3']) as level, unnest([catalog, case when line <> '' then line else catalog end, content, case when trim(f) <> '' then trim(f) else content end]) as x from o)
      select query_id, doc_id, level, cast(ceil(length(x) / 4.0) as bigint) as tokens, sha256(x) as digest from a""",
    "best_term_window": f"""with recursive {HYBRID}, h as (select r.query_id, r.doc_id, d.text, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 6 and not list_contains([{retrieval._STOP}], t))) as terms from ranked r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10),
      p as (select *, greatest(coalesce(list_min(list_filter(list_transform(terms, lambda t: instr(lower(text), t)), lambda i: i > 0)), 1) - 60, 1) as s from h) select query_id, doc_id, substring(text, s, 200) as snippet from p""",
    "evidence_fragment": f"""with recursive {PASSAGES}, e as (select query_id, doc_id, start_line as line, trim(substring(trim(content), 1, 2000)) as x from passage where shown > 0) select query_id, doc_id, line, length(x) as characters, sha256(x) as digest from e""",
    "parent_rehydration": f"""with recursive {HYBRID}, terms as (select item_id as query_id, {retrieval._TOKENS.format("text")} as terms from benchmark), l as (select doc_id, unnest(generate_series(0, len(l) - 1)) as line, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents)),
      f as (select query_id, doc_id, line as unit from lexical join l using (doc_id) join terms using (query_id) where list_has_all(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), terms))
      select query_id, f.doc_id, cast(unit as integer) as unit, string_agg(content, chr(10) order by line) as context, count(*) as lines from f join l on l.doc_id = f.doc_id and l.line between unit - 1 and unit + 1 group by 1, 2, 3""",
    "projection_retains_support": f"with recursive {CANDIDATES} select query_id, doc_id, trim(b.text) <> '' and contains(lower(content), lower(trim(b.text))) as retained from cand join benchmark b on b.item_id = query_id",
    "material_conflicts": f"""with recursive {CANDIDATES}, k as (select query_id, doc_id, regexp_replace(lower(trim(title)), '[^a-z0-9]+', '', 'g') as identity, sha256(body) as h from cand)
      select a.query_id, a.doc_id, b.doc_id as other from k a join k b on a.query_id = b.query_id and a.identity = b.identity and a.doc_id < b.doc_id and a.h <> b.h where a.identity <> ''""",
}
