"""Rules on notes, payloads, locators, links and exports.

Notes are documents with front matter, links and blocks around their text; payloads
are maps made of a document's fields and the JSON of events.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions import text
from ..operators import chunking, filters
from ..sources import bind
from .chunks import UNITS_OF_MARKED

STATUSES = ["draft", "reviewed", "disputed by audit", "active", "deprecated", "Attested", "superseded"]


def notes(spark, d):
    t = bind.table(spark, d, "documents")
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % 7 + 1).cast("int"))
    head = F.concat(F.lit("---\nid: N-"), s(k), F.lit("\nstatus: "), status, F.when(k % 9 != 0, F.lit("\ntype: concept")).otherwise(F.lit("")), F.lit("\n---\n# Note "), s(k), F.lit("\n\n"))
    links = F.concat(F.lit("See [[n"), s(k % 150), F.lit(".md]], [[../fr/n"), s((k + 1) % 150), F.lit("|next]], [["), F.col("source"), F.lit("/en/n"), s((k + 3) % 150), F.lit("#top]] and [[gone"), s(k % 5), F.lit("]].\n\n- one\n- two\n\n```\ncode\n```\n\n| a | b |\n| 1 | 2 |\n\n"))
    return t.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("n"), s(k % 150))).alias("path"), F.col("source").alias("vault"), F.concat(head, links, "text").alias("body"))


def front_matter(spark, d):
    m = doc.front_matter(F.col("body"))
    rows = notes(spark, d).select("doc_id", m.alias("m"))
    required = F.array(*[F.lit(c) for c in ("id", "status", "type")])
    missing = F.array_except(required, F.map_keys("m"))
    return rows.select("doc_id", F.element_at("m", "id").alias("id"), F.element_at("m", "status").alias("status"), F.array_join(missing, ",").alias("missing"))


def lifecycle_trust(spark, d):
    m = doc.front_matter(F.col("body"))
    rows = notes(spark, d).select("doc_id", F.element_at(m, "status").alias("status"), "vault")
    return rows.select("doc_id", doc.lifecycle(F.col("status"), F.col("vault") == "src3").alias("lifecycle"), doc.trust(F.col("status"), F.col("vault") != "src4").alias("trust"))


def _links(spark, d):
    return notes(spark, d).select("doc_id", "path", F.explode(text.wiki_links(F.col("body"))).alias("target"))


def wiki_links(spark, d):
    return _links(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("target").alias("first"), F.max("target").alias("last"))


def link_resolution(spark, d):
    """A link's note by whole path, else by path from its own folder, else by a file
    name that only one note has."""
    n = notes(spark, d).select("doc_id", F.lower("path").alias("key"))
    by_path = n.groupBy("key").agg(F.min("doc_id").alias("found"))
    by_name = n.groupBy(F.regexp_extract("key", "[^/]*$", 0).alias("key")).agg(F.min("doc_id").alias("found"), F.count("*").alias("n")).where("n = 1").drop("n")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    plain = F.lower(F.regexp_replace("target", "^/+", ""))
    rows = _links(spark, d).select("doc_id", "target", plain.alias("direct"), F.lower(doc.joined_path(folder, plain)).alias("near"), F.regexp_extract(plain, "[^/]*$", 0).alias("name"))
    for key, table in (("direct", by_path), ("near", by_path), ("name", by_name)):
        rows = rows.join(table.select(F.col("key").alias(key), F.col("found").alias(f"by_{key}")), key, "left")
    way = F.when(F.col("by_direct").isNotNull(), "PATH").when(F.col("by_near").isNotNull(), "RELATIVE").when(F.col("by_name").isNotNull(), "NAME").otherwise("NONE")
    return rows.select("doc_id", "target", way.alias("way"), F.coalesce("by_direct", "by_near", "by_name").alias("to_doc"))


def _payload(spark, d):
    t = bind.table(spark, d, "documents")
    pairs = {"title": text.first_line(F.col("text")), "lang": F.col("lang"), "api_token": F.lit("x"), "Private-Key": F.lit("k"), "notePath": F.when(F.col("doc_id") % 2 == 0, F.lit("/srv/a")).otherwise(F.lit("notes/a")), "source_path": F.lit("b"), "rawBody": F.lit("r"), "count": F.col("n_chars").cast("string")}
    return t.select("doc_id", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("payload"))


def redaction(spark, d):
    clean = doc.redacted(F.col("payload"), 40)
    return _payload(spark, d).select("doc_id", F.explode(clean).alias("key", "value"))


def audit_bundle(spark, d):
    """One JSON line per document, redacted and with keys in order, and its digest."""
    line = doc.canonical_json(doc.redacted(F.col("payload"), 1 << 20))
    rows = _payload(spark, d).select("doc_id", F.map_filter("payload", lambda k, v: k != "title").alias("payload"))
    return rows.select("doc_id", line.alias("line"), F.sha2(line, 256).alias("digest"))


LOCATORS = [{"lang": "fr", "kind": "1"}, {"kind": "3"}]


def locator_filter(spark, d):
    t = bind.table(spark, d, "documents")
    locator = F.create_map(F.lit("lang"), F.col("lang"), F.lit("kind"), (F.col("doc_id") % 5).cast("string"))
    return t.where(doc.matches_locator(locator, LOCATORS)).select("doc_id", "lang")


def payload_containment(spark, d):
    e = bind.table(spark, d, "events")
    return e.where(filters.contains_pairs(F.col("props"), {"k": "7"})).select("event_id", "event_type")


def json_fields(spark, d):
    """A JSON text's field as number, whether keys are there, its kind and a new object."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    e = bind.table(spark, d, "events").select("event_id", "event_type", k.alias("k"), F.get_json_object("props", "$.x").isNotNull().alias("has_x"), F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")).alias("kind"))
    built = F.to_json(F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("type"), F.col("event_type")))
    return e.select("event_id", "k", "has_x", F.when(F.col("kind") == "BIGINT", "number").otherwise("other").alias("kind"), built.alias("built"))


def json_recordset(spark, d):
    """A user's days as JSON arrays, and back to typed rows."""
    e = bind.table(spark, d, "events")
    packed = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))))).alias("j"))
    rows = F.from_json("j", "array<struct<event_id: bigint, event_type: string, k: int>>")
    return packed.select("user_id", F.explode(rows).alias("r")).select("user_id", "r.event_id", "r.event_type", "r.k")


def extraction_routing(spark, d):
    p = bind.table(spark, d, "pages")
    names = ["a/report.pdf", "b/slides_deck.key", "c/plan.md", "d/ocr.tiff", "e/x.bin", "f/table1.csv", "g/talk"]
    media = ["application/pdf", "application/x", "text/markdown", "image/tiff", "application/octet-stream", "text/csv", "video/mp4"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % 7 + 1).cast("int"))
    return p.select("page_id", doc.complexity(pick(names), pick(media)).alias("complexity"))


def nested_redaction(spark, d):
    """Nested payloads as exports see them."""
    t = bind.table(spark, d, "documents")
    k = F.col("doc_id")
    entry = F.struct(F.lit("p").alias("password"), F.col("lang").alias("Lang"), F.lit("o").alias("licensed_original"))
    inner = F.struct(F.lit("b").alias("raw_body"), F.array(entry, entry).alias("list"), F.when(k % 2 == 0, F.lit("C:\\x")).otherwise(F.lit("x/y")).alias("filePathHint"), F.when(k % 3 == 0, F.lit("/etc")).otherwise(F.lit("etc")).alias("notePath"))
    payload = F.to_json(F.struct(F.col("source").alias("z_source"), inner.alias("Inner"), F.lit("s").alias("apiSecret"), k.alias("n"), F.repeat(F.lit("é"), (k % 30).cast("int")).alias("a")))
    return t.select("doc_id", doc.safe_json(payload, 40).alias("line"))


def markdown_blocks(spark, d):
    """How many blocks of each type a note has below its front matter, and their tokens."""
    rows = notes(spark, d).select("doc_id", F.lit("Note").alias("title"), F.regexp_replace("body", r"(?s)\A---\n.*?\n---\n", "").alias("body"))
    units = chunking.structural_units(rows).where("not container")
    return units.groupBy("doc_id", F.col("unit_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def project_snapshot(spark, d):
    """Declared symbols of made source texts, with their lines."""
    p = bind.table(spark, d, "part")
    source = F.concat(F.lit("import x\nclass "), F.initcap(F.regexp_replace("p_name", "[^a-z]", "")), F.lit(" {\n}\nfunction "), F.lower("p_type"), F.col("p_partkey").cast("string"), F.lit("() {}\n// type none\nenum E"), F.col("p_size").cast("string"))
    lines = p.select("p_partkey", F.posexplode(F.split(source, "\n")).alias("line", "content"))
    found = F.regexp_extract("content", r"^(class|interface|enum|type|function|record)\s+([A-Za-z_$][\w$]*)", 2)
    return lines.select("p_partkey", (F.col("line") + 1).alias("line"), F.upper(F.regexp_extract("content", r"^(\w+)", 1)).alias("kind"), found.alias("name")).where("name <> ''")


LINKS_PER_LINE = 50


def jsonld_export(spark, d):
    """Every node as JSON-LD lines: an id, a type and where its edges lead.  A node with
    many links has numbered lines of about LINKS_PER_LINE, dealt by the other's number."""
    e = bind.edges(spark, d).select("from_id", "to_id").distinct()
    parts = e.groupBy("from_id").agg(F.ceil(F.count("*") / F.lit(LINKS_PER_LINE)).alias("parts"))
    part = F.pmod(F.substring_index("to_id", ":", -1).cast("long"), F.col("parts")).alias("part")
    linked = e.join(parts, "from_id").groupBy("from_id", part).agg(F.array_sort(F.collect_list("to_id")).alias("to"))
    nodes = e.select(F.col("from_id").alias("node")).union(e.select("to_id")).distinct()
    met = nodes.join(linked, nodes.node == linked.from_id, "left").select("node", F.coalesce("part", F.lit(0).cast("long")).alias("part"), F.coalesce("to", F.array().cast("array<string>")).alias("to"))
    links = F.array_join(F.transform("to", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ",")
    body = F.concat(F.lit('{"@id":"'), F.col("node"), F.lit('","@type":"'), F.substring("node", 1, 1), F.lit('","part":'), F.col("part").cast("string"), F.lit(',"links":['), links, F.lit("]}"))
    return met.select("node", "part", body.alias("line"))


def graphml_export(spark, d):
    e = bind.edges(spark, d)
    return e.select(F.concat(F.lit('<edge source="'), "from_id", F.lit('" target="'), "to_id", F.lit('"><data key="relation">'), "relation", F.lit("</data></edge>")).alias("line"))


def import_plan(spark, d):
    """What an import would do with each note: reject, create, update or leave it."""
    n = notes(spark, d).select("doc_id", F.sha2("body", 256).alias("h"), F.element_at(doc.front_matter(F.col("body")), "type").alias("type"))
    stored = n.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("h")).alias("had"))
    met = n.join(stored, "doc_id", "left")
    step = F.when(F.col("type").isNull(), "REJECT").when(F.col("had").isNull(), "CREATE").when(F.col("had") != F.col("h"), "UPDATE").otherwise("KEEP")
    return met.select("doc_id", step.alias("step"))


def nulls_last_sort(spark, d):
    o = bind.table(spark, d, "orders")
    key = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    rows = o.select("o_custkey", "o_orderkey", key.alias("placed"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("placed"), "o_orderkey"))
    return rows.withColumn("n", n).where("n <= 2").select("o_custkey", "o_orderkey", "placed", "n")


def changed_since(spark, d):
    """Facts recorded after an instant, or replaced by one that was."""
    f = bind.facts(spark, d)
    since = F.expr("timestamp_ntz'2024-01-25 00:00:00'")
    new = f.where(F.col("recorded_at") > since).select("fact_id")
    old = bind.supersessions(f).join(new.select(F.col("fact_id").alias("new_id")), "new_id", "left_semi").select(F.col("old_id").alias("fact_id"))
    return new.union(old).distinct()


def revision_gate(spark, d):
    """Channels of a vault that may be used: their index is at the corpus's revision."""
    docs = bind.table(spark, d, "documents").groupBy(F.col("source").alias("vault")).agg(F.count("*").alias("corpus"))
    index = docs.select("vault", F.explode(F.array(*map(F.lit, ["lexical", "vector", "graph"]))).alias("channel"), (F.col("corpus") - F.length("vault") % 2).alias("revision"))
    own = F.when(F.col("channel") == "lexical", F.col("corpus")).otherwise(F.col("revision"))
    return index.join(docs, "vault").select("vault", "channel", (own == F.col("corpus")).alias("usable"))


QUERIES = {f.__name__: f for f in (front_matter, lifecycle_trust, wiki_links, link_resolution, redaction, nested_redaction, audit_bundle, locator_filter, payload_containment, json_fields, json_recordset, extraction_routing, markdown_blocks, project_snapshot, jsonld_export, graphml_export, import_plan, nulls_last_sort, changed_since, revision_gate)}

_STATUS = "['" + "', '".join(STATUSES) + "'][doc_id % 7 + 1]"
NOTES = f"""notes as (select doc_id, source || '/' || lang || '/n' || (doc_id % 150) as path, source as vault, source || '/' || lang as folder, {_STATUS} as status, case when doc_id % 9 <> 0 then 'concept' end as type,
  '---' || chr(10) || 'id: N-' || doc_id || chr(10) || 'status: ' || {_STATUS} || case when doc_id % 9 <> 0 then chr(10) || 'type: concept' else '' end || chr(10) || '---' || chr(10) || '# Note ' || doc_id || chr(10) || chr(10) as head,
  'See [[n' || (doc_id % 150) || '.md]], [[../fr/n' || ((doc_id + 1) % 150) || '|next]], [[' || source || '/en/n' || ((doc_id + 3) % 150) || '#top]] and [[gone' || (doc_id % 5) || ']].' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || text as rest from documents)"""
LINKS = r"links as (select doc_id, path, folder, target from (select doc_id, path, folder, unnest(list_distinct(list_transform(regexp_extract_all(head || rest, '\[\[([^\]|#]+)[^\]]*\]\]', 1), lambda t: regexp_replace(trim(t), '\.md$', '')))) as target from notes))"
PAYLOAD = """payload as (select doc_id, unnest(['title', 'lang', 'api_token', 'Private-Key', 'notePath', 'source_path', 'rawBody', 'count']) as key, unnest([split_part(text, chr(10), 1), lang, 'x', 'k', case when doc_id % 2 = 0 then '/srv/a' else 'notes/a' end, 'b', 'r', n_chars::varchar]) as value from documents),
safe as (select * from payload where key not in ('api_token', 'Private-Key', 'source_path', 'rawBody') and not (key = 'notePath' and value = '/srv/a'))"""

SQL = {
    "front_matter": f"with {NOTES} select doc_id, 'N-' || doc_id as id, status, case when type is null then 'type' else '' end as missing from notes",
    "lifecycle_trust": f"""with {NOTES} select doc_id, case when vault = 'src3' then 'ARCHIVED' else ['DRAFT', 'ACTIVE', 'DISPUTED', 'ACTIVE', 'ARCHIVED', 'ACTIVE', 'SUPERSEDED'][doc_id % 7 + 1] end as lifecycle,
      case when vault = 'src4' then 'UNVERIFIED' else ['MACHINE_SUPPORTED', 'HUMAN_REVIEWED', 'MACHINE_SUPPORTED', 'HUMAN_REVIEWED', 'MACHINE_SUPPORTED', 'ATTESTED', 'MACHINE_SUPPORTED'][doc_id % 7 + 1] end as trust from notes""",
    "wiki_links": f"with {NOTES}, {LINKS} select doc_id, count(*) as n, min(target) as first, max(target) as last from links group by 1",
    "link_resolution": rf"""with {NOTES}, {LINKS}, p as (select lower(path) as key, min(doc_id) as found from notes group by 1), b as (select regexp_extract(lower(path), '[^/]*$') as key, min(doc_id) as found from notes group by 1 having count(*) = 1),
      k as (select doc_id, target, lower(target) as direct, lower(case when starts_with(target, '../') then regexp_replace(folder, '/[^/]*$', '') || '/' || target[4:] else folder || '/' || target end) as near, lower(regexp_extract(target, '[^/]*$')) as name from links)
      select k.doc_id, target, case when d.found is not null then 'PATH' when n.found is not null then 'RELATIVE' when b.found is not null then 'NAME' else 'NONE' end as way, coalesce(d.found, n.found, b.found) as to_doc
      from k left join p d on d.key = direct left join p n on n.key = near left join b on b.key = name""",
    "redaction": f"with {PAYLOAD} select doc_id, key, case when strlen(value) > 40 then substring(value, 1, 40) || '…[TRUNCATED]' else value end as value from safe",
    "audit_bundle": f"""with {PAYLOAD}, j as (select doc_id, '{{' || string_agg('"' || key || '":"' || value || '"', ',' order by key) || '}}' as line from safe where key <> 'title' group by 1) select doc_id, line, sha256(line) as digest from j""",
    "locator_filter": "select doc_id, lang from documents where (lang = 'fr' and doc_id % 5 = 1) or doc_id % 5 = 3",
    "payload_containment": "select event_id, event_type from events where json_extract_string(props, '$.k') = '7'",
    "json_fields": """select event_id, cast(json_extract_string(props, '$.k') as integer) as k, json_extract(props, '$.x') is not null as has_x, 'number' as kind, '{"id":"' || event_id || '","type":"' || event_type || '"}' as built from events""",
    "json_recordset": "select user_id, event_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events",
    "extraction_routing": "select page_id, ['digital', 'complex', 'simple', 'scanned', 'unknown', 'table-heavy', 'media'][page_id % 7 + 1] as complexity from pages",
    "nested_redaction": """select doc_id, '{"Inner":{"filePathHint":"' || case when doc_id % 2 = 0 then 'C:\\\\x' else 'x/y' end || '","list":[{"Lang":"' || lang || '"},{"Lang":"' || lang || '"}]' || case when doc_id % 3 = 0 then '' else ',"notePath":"etc"' end
      || '},"a":"' || case when (doc_id % 30) * 2 > 40 then repeat('é', doc_id % 30) || '…[TRUNCATED]' else repeat('é', doc_id % 30) end || '","n":' || doc_id || ',"z_source":"' || source || '"}' as line from documents""",
    "markdown_blocks": f"""with recursive {NOTES}, marked as (select doc_id, 'Note' as title, '# Note ' || doc_id || chr(10) || chr(10) || rest as raw from notes), {UNITS_OF_MARKED}
      select doc_id, unit_type as kind, count(*) as n, sum(tokens) as tokens from units where not container group by 1, 2""",
    "project_snapshot": """select p_partkey, unnest([2, 4, 6]) as line, unnest(['CLASS', 'FUNCTION', 'ENUM']) as kind, unnest([upper(regexp_replace(p_name, '[^a-z]', '', 'g')[1]) || regexp_replace(p_name, '[^a-z]', '', 'g')[2:], lower(regexp_extract(p_type, '^[A-Za-z_]+')) || case when regexp_matches(p_type, '^[A-Za-z_]+$') then p_partkey::varchar else '' end, 'E' || p_size]) as name from part""",
    "jsonld_export": f"""with e as (select 'N:' || n_nationkey as f, 'R:' || n_regionkey as t, n_regionkey as k from nation union select 'S:' || s_suppkey, 'N:' || s_nationkey, s_nationkey from supplier union select 'N:' || c_nationkey, 'C:' || c_custkey, c_custkey from customer),
      p as (select *, cast(ceil(count(*) over (partition by f) / {LINKS_PER_LINE}.0) as bigint) as parts from e), a as (select f, k % parts as part, list_sort(list(t)) as l from p group by 1, 2), n as (select f as node from e union select t from e)
      select node, coalesce(part, 0) as part, '{{"@id":"' || node || '","@type":"' || node[1] || '","part":' || coalesce(part, 0) || ',"links":[' || array_to_string(list_transform(coalesce(l, []), lambda x: '"' || x || '"'), ',') || ']}}' as line from n left join a on f = node""",
    "graphml_export": """with e as (select 'N:' || n_nationkey as f, 'R:' || n_regionkey as t, 'related_to' as r from nation union all select 'S:' || s_suppkey, 'N:' || s_nationkey, 'derives_from' from supplier union all select 'N:' || c_nationkey, 'C:' || c_custkey, 'supports' from customer)
      select '<edge source="' || f || '" target="' || t || '"><data key="relation">' || r || '</data></edge>' as line from e""",
    "import_plan": "select doc_id, case when doc_id % 9 = 0 then 'REJECT' when doc_id % 4 = 0 then 'CREATE' when doc_id % 3 = 0 then 'UPDATE' else 'KEEP' end as step from documents",
    "nulls_last_sort": "select o_custkey, o_orderkey, placed, n from (select o_custkey, o_orderkey, placed, cast(row_number() over (partition by o_custkey order by placed desc nulls last, o_orderkey) as integer) as n from (select *, case when o_orderstatus <> 'F' then o_orderdate end as placed from orders)) where n <= 2",
    "changed_since": """with f as (select event_id, ts, lead(event_id) over w as new_id, lead(ts) over w as new_ts from events window w as (partition by user_id, event_type order by ts, event_id))
      select event_id as fact_id from f where ts > timestamp '2024-01-25 00:00:00' or new_ts > timestamp '2024-01-25 00:00:00'""",
    "revision_gate": "with s as (select distinct source as vault from documents), c as (select vault, unnest(['lexical', 'vector', 'graph']) as channel from s) select vault, channel, channel = 'lexical' or length(vault) % 2 = 0 as usable from c",
}
