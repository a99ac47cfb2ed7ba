"""Structural units of texts and what is shown of them.

Manuals are documents whose lines got marks of headings, lists, fences, formulas,
tables and figures, by number of document and line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking
from ..sources import bind

#: What lines of manuals begin with; the fifth makes a table's row, which ends in a bar.
MARKS = ["", "## ", "- ", "```\n", "| a | ", "  ", "\n", "$$\n", "![f](u)\n", "# ", "### ", "must ", "1. "]


def manuals(spark, d):
    t = bind.table(spark, d, "documents")
    mark = lambda i: F.pmod(F.col("doc_id") * 7 + i * 3, F.lit(len(MARKS))).cast("int")
    line = lambda x, i: F.concat(F.element_at(F.array(*map(F.lit, MARKS)), mark(i) + 1), x, F.when(mark(i) == 4, " |").otherwise(""))
    return t.select("doc_id", text.first_line(F.col("text")).alias("title"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("body"))


def structural_units(spark, d):
    rows = chunking.structural_units(manuals(spark, d))
    return rows.withColumn("heading_path", F.array_join("heading_path", " / ")).drop("body")


def structural_parents(spark, d):
    """How many units of each type have a section as parent, and what these hold."""
    units = chunking.structural_units(manuals(spark, d))
    met = chunking.parents(units).join(units.select("doc_id", "unit_key", "unit_type"), ["doc_id", "unit_key"])
    return met.groupBy("unit_type").agg(F.count("*").alias("n"), F.sum(F.length("parent_body")).alias("characters"))


def structural_context(spark, d):
    """What is shown of every atom of a manual, around the longest words of its document."""
    units = chunking.structural_units(manuals(spark, d))
    words = F.slice(F.sort_array(F.transform(text.salient(F.col("text"), 6), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), 1, 5)
    terms = bind.table(spark, d, "documents").select("doc_id", F.transform(words, lambda w: w["t"]).alias("terms"))
    rows = units.where("not container").select("doc_id", "unit_key", "parent_key", "body").join(terms, "doc_id")
    rows = rows.join(chunking.parents(units).select("doc_id", "unit_key", "parent_body"), ["doc_id", "unit_key"], "left")
    shown = chunking.rehydrated(rows, 600)
    return shown.select("doc_id", "unit_key", F.length("context").cast("long").alias("characters"), F.sha2("context", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (structural_units, structural_parents, structural_context)}

_M = "[" + ", ".join("'" + m.replace("\n", "' || chr(10) || '") + "'" for m in MARKS) + "]"
_HEAD = "'^" + chunking.HEADING + "'"


def _is(kind: str) -> str:
    return f"regexp_matches(line, '^{chunking.OPENS[kind]}')"


_OPENED = "case when trim(line, ' \t\r\f\v') = '' then null " + " ".join(f"when {_is(k)} then '{k}'" for k in chunking.OPENS) + " else 'PARAGRAPH' end"
_STAYS = f"""(kind in ('CODE', 'EQUATION') or (kind = 'TABLE' and {_is("TABLE")}) or (kind = 'LIST' and ({_is("LIST")} or regexp_matches(line, '^{chunking.INDENTED}')))
  or (kind = 'PARAGRAPH' and trim(line, ' \t\r\f\v') <> '' and not regexp_matches(line, '^(?:{chunking.BREAKS})')))"""
_CLOSED = " or ".join(f"(mine = '{k}' and regexp_matches(line, '^{p}') and begun < i)" for k, p in chunking.CLOSES.items()) + " or mine = 'FIGURE'"
_TYPE = "case " + " ".join(f"when regexp_matches(meant, '{chunking.meaning(k)}') then '{k}'" for k in chunking.MEANINGS) + " else kind end"
#: The state machine as recursion over the lines of a section: mine and begun are a
#: line's block, kind is what is open after it.
UNITS_OF_MARKED = f"""clean as (select doc_id, title, regexp_replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') as body from marked),
numbered as (select doc_id, unnest(generate_series(1, len(x))) as i, unnest(x) as line from (select doc_id, string_split(body, chr(10)) as x from clean where body <> '')),
fenced as (select *, sum({_is("CODE")}::int) over (partition by doc_id order by i) % 2 = 1 as inside from numbered),
headed as (select *, not inside and regexp_matches(line, {_HEAD}) as head from fenced),
cut as (select *, sum(head::int) over (partition by doc_id order by i) as sec from headed),
heads as (select doc_id, sec, length(regexp_extract(line, {_HEAD}, 1)) as depth, trim(regexp_extract(line, {_HEAD}, 2)) as heading from cut where head),
deep as (select a.doc_id, a.sec, g.d, max(b.sec) filter (b.depth = g.d) as own, max(b.sec) filter (b.depth < g.d) as above from heads a, generate_series(1, 6) g(d), heads b where g.d <= a.depth and b.doc_id = a.doc_id and b.sec <= a.sec group by 1, 2, 3),
path as (select x.doc_id, x.sec, array_agg(case when x.own > coalesce(x.above, 0) then b.heading else '' end order by x.d) as path from deep x left join heads b on b.doc_id = x.doc_id and b.sec = x.own group by 1, 2),
body as (select doc_id, sec, i, line, row_number() over (partition by doc_id, sec order by i) as r from cut where not head),
state(doc_id, sec, r, i, mine, begun, kind) as (
  select doc_id, sec, r, i, mine, i, case when mine = 'FIGURE' then null else mine end from (select *, {_OPENED} as mine from body where r = 1)
  union all select doc_id, sec, r, i, mine, begun, case when {_CLOSED} then null else mine end from (
    select doc_id, sec, r, i, line, case when stays then kind else {_OPENED} end as mine, case when stays then begun else i end as begun from (
      select b.doc_id, b.sec, b.r, b.i, b.line, s.kind, s.begun, coalesce({_STAYS}, false) as stays from state s join body b on b.doc_id = s.doc_id and b.sec = s.sec and b.r = s.r + 1))),
block as (select s.doc_id, s.sec, mine as kind, begun as first, max(s.i) as last, regexp_replace(string_agg(line, chr(10) order by s.i), '^\\s+|\\s+$', '', 'g') as part from state s join body b on b.doc_id = s.doc_id and b.sec = s.sec and b.i = s.i where mine is not null group by 1, 2, 3, 4),
section as (select doc_id, sec, min(i) filter (trim(line, ' \t\r\f\v') <> '') as first, max(i) as last, regexp_replace(string_agg(line, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as part, row_number() over (partition by doc_id order by sec) as no from body where sec > 0 group by doc_id, sec having count(*) filter (trim(line, ' \t\r\f\v') <> '') > 0),
every as (select doc_id, 0 as sec, 'DOCUMENT' as kind, 1 as first, greatest(len(string_split(body, chr(10))), 1) as last, body as part, 0 as place from clean
  union all select doc_id, sec, 'SECTION', first, last, part, 1 from section union all select doc_id, sec, kind, first, last, part, 2 from block),
typed as (select e.*, row_number() over (partition by e.doc_id order by place > 0, e.sec, place, e.first) - 1 as structural_order, s.no, case when place = 0 then [c.title] else coalesce(p.path, [c.title]) end as path,
  lower(array_to_string(case when place = 0 then [c.title] else coalesce(p.path, [c.title]) end, ' ') || ' ' || substring(e.part, 1, {chunking.MEANT})) as meant
  from every e join clean c using (doc_id) left join section s on s.doc_id = e.doc_id and s.sec = e.sec left join path p on p.doc_id = e.doc_id and p.sec = e.sec),
named as (select *, case when kind in ('PARAGRAPH', 'LIST') then {_TYPE} when kind = 'CODE' then 'CODE_EVIDENCE' else kind end as unit_type, case when no is null then 'document' else 'section-' || no end as home, sha256(part) as content_hash from typed),
units as (select doc_id, case when place < 2 then home else home || '-' || lower(unit_type) || '-' || lpad(cast(first as varchar), 6, '0') || '-' || substring(content_hash, 1, 10) end as unit_key,
  case place when 0 then null when 1 then 'document' else home end as parent_key, unit_type, path, part as body, content_hash, cast(ceil(length(part) / 4.0) as bigint) as tokens, cast(structural_order as integer) as structural_order, cast(first as integer) as start_line, cast(last as integer) as end_line, place < 2 as container from named)"""
#: The manuals, and the documents as they are.
MANUALS = f"""marked as (select doc_id, split_part(text, chr(10), 1) as title, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: ({_M})[(doc_id * 7 + (i - 1) * 3) % 13 + 1] || x || case when (doc_id * 7 + (i - 1) * 3) % 13 = 4 then ' |' else '' end), chr(10)) as raw from documents)"""
PLAIN = "marked as (select doc_id, split_part(text, chr(10), 1) as title, text as raw from documents)"
UNITS = f"{MANUALS},\n{UNITS_OF_MARKED}"
PLAIN_UNITS = f"{PLAIN},\n{UNITS_OF_MARKED}"

SQL = {
    "structural_units": f"with recursive {UNITS} select doc_id, unit_key, parent_key, unit_type, array_to_string(path, ' / ') as heading_path, content_hash, tokens, structural_order, start_line, end_line, container from units",
    "structural_parents": f"with recursive {UNITS} select u.unit_type, count(*) as n, sum(length(p.body)) as characters from units u join units p on p.doc_id = u.doc_id and p.unit_key = u.parent_key and p.unit_type = 'SECTION' where not u.container group by 1",
}
