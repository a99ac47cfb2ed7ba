"""What a question asks for and whether a passage answers that, by cue words in two languages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STOP_WORDS

#: Words of a question by what it asks for; a star stands for any ending.
ASKED = {
    "PROCEDURE": "how, como, de que manera, mediante que, procedimiento",
    "PREVENTION": "avoid*, prevent*, duplicate*, repeat*, stop*, not use, evit*, preven*, duplic*, repet*, deten*, no usar",
    "CONDITION": "when, cuando, under what, en que caso, en que casos",
    "RATIONALE": "why, por que, razon, motivo",
    "RULE": "rule, policy, bounded, regla, politica",
    "DEFINITION": "what is, que es, define*, significa*",
    "COMPARISON": "compare*, versus, difference, diferencia, compar*, frente a",
}
#: Words of a passage that answers such a question.
ANSWERED = {
    "PROCEDURE": "must, require*, through, via, submit*, file*, apply*, check*, consult*, persist*, record*, step, then, mediante, debe, requiere, enviar*, consult*, guardar*, registr*",
    "PREVENTION": "avoid*, prevent*, duplicate*, repeat*, twice, idempot*, deduplic*, side effect*, poor fit, not recommended, outweigh*, evit*, preven*, duplic*, repet*, dos veces, sin efectos",
    "CONDITION": "when, if, unless, where, under, only when, scenario*, condition*, threshold*, poor fit, not recommended, suitable only, appropriate only, cuando, si, salvo, donde, bajo, caso, umbral",
    "RATIONALE": "because, due, reason, therefore, tradeoff, overhead, complexity, cost*, porque, debido, razon, motivo, sobrecarga, complejidad, costo*",
    "RULE": "bounded, limit*, maximum, minimum, must, policy, rule, acotad*, limite, maximo, minimo, debe, politica, regla",
    "DEFINITION": "means, defined, refers to, consists of, significa, se define, consiste en",
    "COMPARISON": "versus, compared, unlike, tradeoff, better, worse, prefer*, rather than, frente a, comparad*, diferencia, mejor, peor",
}
#: Tokens count from this length on; what support by text and by cues takes.
LEAST = 2
COVERAGE, OVERLAP, VECTOR_RANK = 0.4, 2, 5

_TOKEN = re.compile(r"[^\W_]+")


def bare(value: str | None) -> str:
    """Lower case without accents, compatible forms as one (NFKD)."""
    return "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.category(c).startswith("M")).lower()


def _line(value: str | None) -> str:
    return f" {' '.join(dict.fromkeys(t for t in _TOKEN.findall(bare(value)) if len(t) >= LEAST))} "


def pattern(cues: str) -> str:
    """A pattern for a line of distinct tokens with blanks around each."""
    out = []
    for cue in cues.split(", "):
        words = [w for w in _TOKEN.findall(cue) if len(w) >= LEAST]
        out.append(" " + " ".join(words) + ("" if cue.endswith("*") and len(words) == 1 else " "))
    return "|".join(out)


_ASKED, _ANSWERED = ({k: re.compile(pattern(v)) for k, v in x.items()} for x in (ASKED, ANSWERED))


def identifier(query: str) -> bool:
    """Whether a query is a name to look up, not a question."""
    query = query.strip()
    plain = bool(re.fullmatch(r"[\w.:/-]+", query))
    return plain and (bool(re.search(r"[\d_:/.]", query)) or ("-" in query and query == query.upper()))


def asked(query: str) -> list[str]:
    return [] if identifier(query) else [k for k, p in _ASKED.items() if p.search(_line(query))]


def retains(passage: str, query: str) -> bool:
    """Whether a passage that was cut still supports a query: it holds the query, and
    what is left without it answers what the query asks for."""
    needle = query.strip()
    at = passage.lower().find(needle.lower())
    if not needle or not passage.strip() or at < 0:
        return False
    rest = _line(passage[:at] + " " + passage[at + len(needle) :])
    return all(_ANSWERED[k].search(rest) for k in asked(query))


@F.pandas_udf(T.StringType())
def folded(values: pd.Series) -> pd.Series:
    """bare() of a column: Spark has no function for compatible forms."""
    return values.map(bare)


def words(value: Column) -> Column:
    """Distinct tokens of a folded text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) >= LEAST))


def _held(tokens: Column, table: dict[str, str]) -> Column:
    shown = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.array_compact(F.array(*[F.when(shown.rlike(pattern(v)), k) for k, v in table.items()]))


NAME = r"^[\p{L}\p{N}_.:/-]+$"


def signal(query: Column, query_words: Column, passage: Column, passage_words: Column, vector_rank: Column) -> dict[str, Column]:
    """Columns supported, reason, coverage, required and matched of a passage for a query.

    By text: enough salient words of the query are in the passage, and it answers all
    that the query asks for.  By cues: it answers that, and is among the first by vector.
    """
    trimmed = F.trim(query)
    name = trimmed.rlike(NAME) & (trimmed.rlike(r"[0-9_:/.]") | (F.contains(trimmed, F.lit("-")) & (trimmed == F.upper(trimmed))))
    required = F.when(name, F.array().cast("array<string>")).otherwise(_held(query_words, ASKED))
    matched = F.array_intersect(required, _held(passage_words, ANSWERED))
    salient = F.filter(query_words, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))
    n, met = F.size(salient), F.size(F.array_intersect(salient, passage_words))
    answered = F.size(matched) == F.size(required)
    share = F.when(n > 0, met / n).otherwise(0.0)
    text = (n > 0) & (met >= F.least(F.lit(OVERLAP), F.greatest(n, F.lit(1)))) & (share >= COVERAGE) & answered
    cue = (F.size(required) > 0) & answered & F.coalesce(vector_rank <= VECTOR_RANK, F.lit(False))
    reason = F.when(F.trim(F.coalesce(passage, F.lit(""))) == "", "NO_CONCRETE_PASSAGE").when(text, "PASSAGE_TEXT_SUPPORT").when(cue, "PASSAGE_CUE_SUPPORT").when(~answered, "ANSWER_CUE_MISMATCH").otherwise("PASSAGE_SUPPORT_NOT_DEMONSTRATED")
    return {"supported": reason.isin("PASSAGE_TEXT_SUPPORT", "PASSAGE_CUE_SUPPORT"), "reason": reason, "coverage": F.round(share, 6), "required": F.array_join(required, ","), "matched": F.array_join(matched, ",")}
