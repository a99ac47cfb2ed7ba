"""Structural units of Markdown texts: documents and sections as containers, blocks as atoms.

A small state machine goes over the lines of a text once, in Arrow batches, and gives
spans; types, digests, keys and estimates are column expressions over these.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What opens a block, in order of precedence; other lines open a paragraph.
OPENS = {
    "CODE": r"\s*```",
    "EQUATION": r"\s*\$\$",
    "FIGURE": r"\s*!\[[^\]]*\]\([^)]*\)",
    "TABLE": r"\s*\|.*\|\s*$",
    "LIST": r"\s*(?:[-*+] |[0-9]+[.)] )",
}
#: What closes a block that runs over all lines before that.
CLOSES = {"CODE": r"\s*```", "EQUATION": r"\s*\$\$\s*$"}
#: A list goes on in indented lines, and what breaks a paragraph.
INDENTED = r"\s{2,}\S"
BREAKS = r"\s*```|\s*\$\$|\s*!\[|\s*\|.*\|\s*$|\s*(?:[-*+] |[0-9]+[.)] )"
HEADING = r"(#{1,6})\s+(.+?)\s*$"
#: The type of a paragraph or list by what its heading or beginning holds,
#: in order of precedence.  ``~`` is the end of a word of ASCII letters.
MEANINGS = {
    "COUNTEREXAMPLE": r"\bcounterexample|contraejemplo|anti-pattern|antipatr[oó]n~",
    "PRECONDITION": r"\bprecondition|precondici[oó]n|given|dado que~",
    "EXAMPLE": r"\bexample|ejemplo~",
    "EVIDENCE": r"\bevidence|evidencia|locator|localizador|citation|cita~",
    "SOURCE_EXCERPT": r"\bsource excerpt|extracto de fuente|verbatim~",
    "RULE": r"\brule|regla|must|must not|debe|no debe~",
    "WORKFLOW_STEP": r"\bstep|paso|workflow|flujo|then|cuando~",
}
#: Fixed value: the characters of a text that tell its type.
MEANT = 240

_OPENS, _CLOSES = ({k: re.compile(v) for k, v in x.items()} for x in (OPENS, CLOSES))
_INDENTED, _BREAKS, _HEADING = map(re.compile, (INDENTED, BREAKS, HEADING))


def meaning(kind: str) -> str:
    """The pattern of a type, for engines with and without look-ahead."""
    return MEANINGS[kind].replace(r"\b", "(^|[^0-9a-z_])", 1).replace("~", "([^0-9a-z_]|$)")


def _goes_on(kind: str, line: str) -> bool:
    if kind == "TABLE":
        return bool(_OPENS["TABLE"].match(line))
    if kind == "LIST":
        return bool(_OPENS["LIST"].match(line) or _INDENTED.match(line))
    return kind == "PARAGRAPH" and bool(line.strip()) and not _BREAKS.match(line)


def blocks(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first, last, kind) of each block of some lines."""
    kind, first = None, 0
    for i, line in enumerate(lines):
        if kind in _CLOSES:
            if _CLOSES[kind].match(line):
                yield first, i, kind
                kind = None
            continue
        if kind and _goes_on(kind, line):
            continue
        if kind:
            yield first, i - 1, kind
        kind, first = next((k for k, p in _OPENS.items() if p.match(line)), "PARAGRAPH") if line.strip() else None, i
        if kind == "FIGURE":
            yield i, i, kind
            kind = None
    if kind:
        yield first, len(lines) - 1, kind


def sections(lines: list[str]) -> Iterator[tuple[list[str], int, int]]:
    """(path of headings, first line, end) of each section, the part before all headings
    too.  A heading inside a fence is none; a level that is skipped is empty."""
    path, start, fenced = [], 0, False
    for i, line in enumerate(lines):
        fenced ^= bool(_OPENS["CODE"].match(line))
        found = None if fenced else _HEADING.match(line)
        if found:
            yield path, start, i
            depth = len(found[1])
            path = [*path[: depth - 1], *[""] * (depth - 1 - len(path)), found[2].strip()]
            start = i + 1
    yield path, start, len(lines)


def spans(body: str) -> Iterator[tuple[int, int, str, list[str], int, int, str]]:
    """(order, section, kind, headings, first line, last line, text) of a normal body.

    Lines count from 1; section 0 has no heading; sections without text aren't numbered.
    """
    lines = body.split("\n") if body else []
    yield 0, 0, "DOCUMENT", [], 1, max(len(lines), 1), body
    order = number = 0
    for path, start, end in sections(lines):
        part = lines[start:end]
        held = next((i for i, x in enumerate(part) if x.strip()), None)
        if held is None:
            continue
        if path:
            number, order = number + 1, order + 1
            yield order, number, "SECTION", path, start + held + 1, max(end, start + held + 1), "\n".join(part).strip()
        for first, last, kind in blocks(part):
            order += 1
            yield order, number if path else 0, kind, path, start + first + 1, start + last + 1, "\n".join(part[first : last + 1]).strip()


#: Fixed value: texts that are taken out of a batch at once.
PIECE = 128
_SPANS = "doc_id long, title string, structural_order int, section int, kind string, heading_path array<string>, start_line int, end_line int, body string, before int"


def literals(kind: str) -> list[str]:
    """Of each way in which a type's pattern is met, the longest part that is plain text."""
    return [max(re.split(r"\\b|~|\[[^\]]*\]", way), key=len) for way in MEANINGS[kind].split("|")]


def _types(value: Column, otherwise: Column) -> Column:
    out = otherwise
    for kind in reversed(MEANINGS):
        # plain text is found far faster than a pattern, which most values can't meet
        likely = reduce(or_, (value.contains(x) for x in literals(kind)))
        out = F.when(likely & value.rlike(meaning(kind)), kind).otherwise(out)
    return out


def structural_units(docs: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """Units of rows (doc_id, title, body): the document, its sections and their blocks.

    (doc_id, unit_key, parent_key, unit_type, heading_path, body, content_hash, tokens,
    structural_order, start_line, end_line, container).  Containers are there for
    parents; only atoms are to be embedded.  Lines count in the body with plain line
    ends and without outer white space; a null body is an empty one.  Each row is
    taken by itself, so nothing is shuffled.  With ``count`` there is ``before`` too: the
    sum of it over the lines before a unit's text.
    """

    def run(batches):
        fields = pa.schema([("doc_id", pa.int64()), ("title", pa.string()), ("structural_order", pa.int32()), ("section", pa.int32()), ("kind", pa.string()), ("heading_path", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32()), ("body", pa.string()), ("before", pa.int32())])
        # a batch has as many texts as the session says; only some are Python's at once
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            rows, held = [], 0
            for doc_id, title, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "title", "body")), strict=True):
                body = (body or "").replace("\r\n", "\n").replace("\r", "\n").strip()
                at, before, lines = 0, 0, None
                for order, section, kind, path, first, last, part in spans(body):
                    if count and first - 1 > at:  # units come by their first lines
                        lines = lines or body.split("\n")
                        before += sum(map(count, lines[at : first - 1]))
                        at = first - 1
                    rows.append((doc_id, title, order, section, kind, path or [title or ""], first, last, part, before))
                    held += len(part)
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "body").mapInArrow(run, _SPANS)
    kind, container = F.col("kind"), F.col("kind").isin("DOCUMENT", "SECTION")
    beginning = F.lower(F.concat(F.array_join("heading_path", " "), F.lit(" "), F.substring("body", 1, MEANT)))
    unit_type = F.when(kind.isin("PARAGRAPH", "LIST"), _types(F.col("beginning"), kind)).when(kind == "CODE", "CODE_EVIDENCE").otherwise(kind)
    typed = found.withColumn("beginning", beginning).withColumn("unit_type", unit_type).withColumn("content_hash", F.sha2("body", 256))
    home = F.when(F.col("section") > 0, F.concat(F.lit("section-"), F.col("section").cast("string"))).otherwise(F.lit("document"))
    key = F.concat_ws("-", home, F.lower("unit_type"), F.lpad(F.col("start_line").cast("string"), 6, "0"), F.substring("content_hash", 1, 10))
    parent = F.when(kind == "SECTION", "document").when(kind != "DOCUMENT", home)
    return typed.select("doc_id", F.when(container, home).otherwise(key).alias("unit_key"), parent.alias("parent_key"), "unit_type", "heading_path", "body", "content_hash", text.token_estimate(F.col("body")).alias("tokens"), "structural_order", "start_line", "end_line", container.alias("container"), *(["before"] if count else []))


def parents(units: DataFrame) -> DataFrame:
    """(doc_id, unit_key, parent_type, parent_body) of the atoms whose parent is a section.

    A document as parent would give the whole text back, so it isn't one here.
    """
    held = units.where("unit_type = 'SECTION'").select("doc_id", F.col("unit_key").alias("parent_key"), F.col("unit_type").alias("parent_type"), F.col("body").alias("parent_body"))
    return units.where("not container").join(held, ["doc_id", "parent_key"]).select("doc_id", "unit_key", "parent_type", "parent_body")


def around(value: str, at: int, size: int, limit: int) -> str:
    """``limit`` characters with ``value[at : at + size]`` in the middle, ellipses included."""
    before = "…" if at > 0 else ""
    after = "…" if at + size < len(value) else ""
    room = max(1, limit - len(before) - len(after))
    start = max(0, min(at - room // 2, len(value) - room))
    return (before + value[start : start + room].strip() + after)[:limit]


def beginning(value: str, limit: int) -> str:
    return value if len(value) <= limit else value[: limit - 1].rstrip() + "…" if limit > 1 else value[:limit]


#: Fixed value: places of one term that are looked at.
PLACES = 32


def best_window(value: str, terms: list[str], limit: int) -> str:
    """The ``limit`` characters that show most of the terms: most terms, then most
    characters of them, then the closest together, then the first."""
    if len(value) <= limit:
        return value
    low, room = value.lower(), max(1, limit - 2)
    low = low if len(low) == len(value) else value
    places = []
    for term in terms:
        at = low.find(term)
        for _ in range(PLACES):
            if at < 0:
                break
            places.append(at)
            at = low.find(term, at + len(term))
    best = None
    for start in sorted({max(0, min(at - room // 2, len(value) - room)) for at in places}):
        shown = low[start : start + room]
        met = [t for t in terms if t in shown]
        if not met:
            continue
        width = max(shown.rfind(t) + len(t) for t in met) - min(shown.find(t) for t in met)
        score = (-len(met), -sum(map(len, met)), width, start)
        best = min(best, score) if best else score
    if not best:
        return beginning(value, limit)
    start, before = best[3], "…" if best[3] > 0 else ""
    end = min(len(value), start + max(1, limit - len(before) - 1))
    return (before + value[start:end].strip() + ("…" if end < len(value) else ""))[:limit]


#: Fixed value: what an atom may take of a context at most.
ATOM = 1600


def context(atom: str, parent: str | None, terms: list[str], limit: int) -> str:
    """What is shown of an atom: its section around it, both within bounds."""
    atom, parent = atom.strip(), (parent or "").strip()
    own = min(limit, ATOM)
    alone = best_window(atom, terms, own) if terms else beginning(atom, own)
    if not atom or not parent or parent == atom:
        return alone
    if terms and len(atom) > limit:
        return best_window(parent, terms, limit)
    at = parent.find(atom)
    if len(parent) <= limit:
        return parent
    return around(parent, at, len(atom), limit) if at >= 0 else beginning(parent, limit)


def rehydrated(rows: DataFrame, limit: int = 3600) -> DataFrame:
    """``rows`` (…, body, parent_body, terms) with ``context`` of ``limit`` characters
    at most: an atom's bounded part of its section, where the terms stand."""

    def run(batches):
        for b in batches:
            held = zip(*(b.column(c).to_pylist() for c in ("body", "parent_body", "terms")), strict=True)
            shown = [context(atom or "", parent, [t for t in terms or [] if t], limit) for atom, parent, terms in held]
            yield pa.record_batch([*b.columns, pa.array(shown, pa.string())], [*b.schema.names, "context"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, context string")
