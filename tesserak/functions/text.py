"""Column functions on text, built from Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in support checks.
STOP_WORDS = """a an and are because can como con cual cuales cuando de del debe durante el en es esta este for from
how is la las los para por puede que should the un una what when where which why""".split()

#: The shapes of a query and the words or phrases that show them.
SHAPES = {
    "NATURAL_LANGUAGE_CONCEPTUAL": ["explain", "what", "why", "how", "concept", "define", "describe", "explica", "que", "qué", "por que", "por qué", "como", "cómo", "concepto"],
    "VERSION_SENSITIVE_CURRENT": ["current", "currently", "latest", "active", "effective", "today", "now", "vigente", "actual", "actualmente", "ultimo", "último", "ultima", "última", "activo", "activa", "efectivo", "efectiva", "hoy", "ahora"],
    "AS_OF_TEMPORAL": ["as of", "asof", "historical", "history", "historico", "histórico", "historica", "histórica", "en fecha", "at version", "at revision"],
    "CODE_SYMBOL_OR_PATH": ["code", "codigo", "código", "symbol", "simbolo", "símbolo", "class", "clase", "function", "funcion", "función", "method", "metodo", "método", "file", "archivo", "path", "ruta", "repository", "repositorio"],
    "MULTI_HOP": ["multihop", "multi hop", "trace", "traverse", "dependency path", "dependency chain", "impact", "impacto", "afecta", "dependenc", "cadena", "recorrido"],
    "CORPUS_GLOBAL_SYNTHESIS": ["global", "synthesis", "sintesis", "síntesis", "panorama", "whole corpus", "todo el corpus", "corpus wide"],
    "TICKET_WORK_PROCESS": ["ticket", "issue", "jira", "linear", "work item", "workitem", "workflow", "process", "task", "handoff", "claim", "incident", "incidente", "tarea", "flujo", "proceso"],
    "COMPARISON": ["compare", "comparison", "comparar", "versus", "diferencia", "difference", "vs"],
    "SOURCE_VERIFICATION": ["source", "fuente", "evidence", "evidencia", "verify", "verification", "verifica", "citation", "cita"],
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def salient(text: Column, least: int = 3) -> Column:
    """Distinct tokens of at least ``least`` characters that aren't stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS)))


def normalize_identity(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: the key of an identity."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")


def symbol_text(text: Column) -> Column:
    """A code symbol's words: camel case, acronyms and punctuation become spaces."""
    out = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(out, "[^A-Za-z0-9]+", " ")))


#: Fixed value: what cuts a query into parts.
DELIMITER = r"(?i)(?:\s*;\s*|\s*\n+\s*|\s+\bvs\.?\b\s+|\s+\bversus\b\s+|\s+\bfrente\s+a\b\s+|\s+\bcontra\b\s+)"


def query_parts(text: Column, most: int = 4) -> Column:
    """A query's parts: cut at semicolons and words of comparison that stand alone,
    distinct, of three characters at least and other than the query itself."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    parts = F.filter(F.transform(F.split(flat, DELIMITER), F.trim), lambda p: F.length(p) >= 3)
    return F.slice(F.filter(F.array_distinct(parts), lambda p: F.lower(p) != F.lower(flat)), 1, most)


def shapes(text: Column) -> Column:
    """The names of SHAPES whose words or phrases a text holds, joined by commas."""
    words, line = tokens(text), F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    shown = []
    for name, cues in SHAPES.items():
        single = F.arrays_overlap(words, F.array(*[F.lit(c) for c in cues if " " not in c]))
        phrase = [F.contains(line, F.lit(f" {c} ")) for c in cues if " " in c]
        shown.append(F.when(reduce(lambda x, y: x | y, phrase, single), F.lit(name)))
    return F.array_join(F.array(*shown), ",")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def wiki_links(text: Column) -> Column:
    """Distinct targets of [[target#part|label]] links, without ``.md``."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.trim(t), r"\.md$", "")))


def unsafe_markup(text: Column) -> Column:
    """Whether a text holds active tags, event handlers or script addresses."""
    return F.lower(text).rlike(r"<\s*(script|iframe|object|embed)\b|\bon[a-z]+\s*=|javascript:")
