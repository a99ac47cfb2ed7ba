"""What a query asks for and how to look for it, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SHAPES, tokens

#: The words that show an intent, in order of precedence; those of the
#: first begin a word, the others are whole words.
INTENTS = {
    "IMPACT_ANALYSIS": ["impact", "impacto", "afecta", "dependenc"],
    "SOURCE_VERIFICATION": ["source", "fuente", "evidencia", "verify", "verifica", "citation", "cita"],
    "PROJECT_CODE": ["repository", "repositorio", "code", "codigo", "clase", "symbol", "commit"],
    "COMPARISON": ["compare", "comparison", "comparar", "versus", "vs", "diferencia"],
    "WORKFLOW_EXECUTION": ["workflow", "flujo", "pasos", "proceso", "ejecuta"],
    "GLOBAL_SYNTHESIS": ["global", "sintesis", "panorama", "todo el corpus"],
}
BEGINNINGS = {"IMPACT_ANALYSIS"}
#: Channels of an intent, and the capability that a channel needs.
CHANNELS = {
    "EXACT_LOOKUP": ["exact", "lexical"],
    "CONCEPTUAL": ["exact", "lexical", "vector"],
    "COMPARISON": ["exact", "lexical", "vector"],
    "WORKFLOW_EXECUTION": ["context-pack", "exact", "lexical"],
    "SOURCE_VERIFICATION": ["exact", "lexical", "graph", "raw"],
    "PROJECT_CODE": ["context-pack", "exact", "lexical", "graph", "code"],
    "GLOBAL_SYNTHESIS": ["lexical", "vector", "graph"],
    "IMPACT_ANALYSIS": ["exact", "graph"],
    "NO_RETRIEVAL_REQUIRED": [],
}
NEEDS = {"vector": "vector", "graph": "graph", "raw": "raw", "code": "code", "context-pack": "context_pack"}
#: Intents whose vector channel isn't even asked for without vectors.
OPTIONAL_VECTOR = ["CONCEPTUAL", "COMPARISON"]
#: What an identifier, and code, look like.
IDENTIFIER = r"\b[A-Z][A-Z0-9]{1,15}(?:[-_][A-Z0-9]+)+\b|[/\\][\w.-]+\.(?:md|ts|tsx|java|cs|py)|\b[A-Z][A-Za-z0-9]+(?:Service|Controller|Repository)\b"
CODE = r"[/\\][\w.-]+\.(?:md|ts|tsx|js|jsx|java|cs|py|go|rs)|\b[A-Z][A-Za-z0-9]+(?:Service|Controller|Repository|Client|Handler)\b|\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*|\.[A-Za-z_][A-Za-z0-9_]*)+\b"
#: Words about access, and the shape that an intent brings along.
ACCESS = """permission permissions authorized authorization acl rbac scope vault tenant federated federation peer
cross-space cross-tenant permiso permisos autorizacion autorización alcance boveda bóveda inquilino federado federada""".split()
IMPLIED = {"CONCEPTUAL": "NATURAL_LANGUAGE_CONCEPTUAL", "PROJECT_CODE": "CODE_SYMBOL_OR_PATH", "IMPACT_ANALYSIS": "MULTI_HOP", "GLOBAL_SYNTHESIS": "CORPUS_GLOBAL_SYNTHESIS", "WORKFLOW_EXECUTION": "TICKET_WORK_PROCESS", "COMPARISON": "COMPARISON", "SOURCE_VERIFICATION": "SOURCE_VERIFICATION"}
#: Hops of a graph walk for a question of one step and of several.
HOPS = (1, 3)
#: Sections of a document that may be shown, in a synthesis and else.
PER_DOCUMENT = (1, 3)


def shape_names() -> list[str]:
    return ["EXACT_IDENTIFIER", *SHAPES, "PERMISSION_SENSITIVE_FEDERATED"]


def words_pattern(words: list[str], beginnings: bool = False) -> str:
    """A pattern for a line of tokens with a blank before, between and after them."""
    return " (" + "|".join(w.replace("-", " ") for w in words) + ")" + ("" if beginnings else " ")


def line(query: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(query, F.lit(""))), " "), F.lit(" "))


def intent(query: Column, requested: Column) -> Column:
    """The requested intent if there is such a one, else that of the first words that
    show one, else a look-up of an identifier, else a conceptual question."""
    asked = F.upper(F.trim(requested))
    out = F.when(query.rlike(IDENTIFIER), "EXACT_LOOKUP").otherwise("CONCEPTUAL")
    for name in reversed(INTENTS):
        out = F.when(line(query).rlike(words_pattern(INTENTS[name], name in BEGINNINGS)), name).otherwise(out)
    return F.when(asked.isin(list(CHANNELS)), asked).otherwise(out)


def shapes(query: Column, of: Column) -> Column:
    """The names of all shapes that a query has, given its intent."""
    tests = {"EXACT_IDENTIFIER": query.rlike(IDENTIFIER), **{n: line(query).rlike(words_pattern(w)) for n, w in SHAPES.items()}, "PERMISSION_SENSITIVE_FEDERATED": line(query).rlike(words_pattern(ACCESS))}
    tests["CODE_SYMBOL_OR_PATH"] = tests["CODE_SYMBOL_OR_PATH"] | query.rlike(CODE)
    for name, shape in IMPLIED.items():
        tests[shape] = tests[shape] | (of == name)
    return F.array_compact(F.array(*[F.when(tests[n], n) for n in shape_names()]))


def plan(query: Column, requested: Column, can: Callable[[str], Column]) -> dict[str, Column]:
    """Columns intent, shapes, strategy, channels, omitted, max_hops, require_evidence and
    per_document of a query; ``can`` gives a capability (vector, graph, community, raw,
    code, context_pack), and a null one is none."""
    query = F.coalesce(query, F.lit(""))
    has = lambda name: F.coalesce(can(name), F.lit(False))
    of = intent(query, requested)
    wanted = F.array().cast("array<string>")
    for name, channels in CHANNELS.items():
        listed = F.array(*map(F.lit, channels)).cast("array<string>")
        if name in OPTIONAL_VECTOR:
            listed = F.when(has("vector"), listed).otherwise(F.array(*[F.lit(c) for c in channels if c != "vector"]))
        wanted = F.when(of == name, listed).otherwise(wanted)
    missing = F.array_compact(F.array(*[F.when(~has(need), c) for c, need in NEEDS.items()]))
    held = shapes(query, of)
    channels = F.array_except(wanted, missing)
    strategy = F.when((of == "IMPACT_ANALYSIS") & has("graph"), "ASSOCIATIVE").when((of == "GLOBAL_SYNTHESIS") & has("community"), "GLOBAL").when(of.isin(OPTIONAL_VECTOR) & has("community"), "DRIFT").otherwise("LOCAL")
    return {
        "intent": of,
        "shapes": held,
        "strategy": strategy,
        "channels": channels,
        "omitted": F.array_intersect(wanted, missing),
        "max_hops": F.when(~F.array_contains(channels, "graph"), 0).when(F.array_contains(held, "MULTI_HOP"), HOPS[1]).otherwise(HOPS[0]),
        "require_evidence": of == "SOURCE_VERIFICATION",
        "per_document": F.when(F.array_contains(held, "CORPUS_GLOBAL_SYNTHESIS"), PER_DOCUMENT[0]).otherwise(PER_DOCUMENT[1]),
    }
