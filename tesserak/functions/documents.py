"""Column functions on front matter, JSON payloads, locators, paths and links."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that an export leaves out, as a pattern on the key and as names
#: without underscores and hyphens.
SENSITIVE_KEY = r"(?i)(?:secret|token|password|credential|authorization|private[_-]?key|object[_-]?key|blob|binary|raw(?:_|$)|body(?:_|$)|bytes|(?:^|_)content[_-]?bytes$|(?:^|_)data$|(?:^|_)(?:source|local|canonical|host|absolute|file)[_-]?path$|(?:^|_)source[_-]?uri$)"
SENSITIVE_NAMES = ["privatekey", "objectkey", "rawbody", "rawcontent", "rawdata", "bodycache", "contentbytes", "sourceuri", "localpath", "canonicalpath", "hostpath", "absolutepath", "filepath", "licensedoriginal", "licensoriginal", "originalblob", "originalbytes"]
#: File endings of simple documents, and words of a name that show a complexity.
SIMPLE = [".md", ".markdown", ".txt", ".html", ".htm", ".docx", ".pptx", ".xlsx"]
HINTS = {"scanned": "scanned", "ocr": "scanned", "formula": "formula", "equation": "formula", "table": "table-heavy", "complex": "complex", "academic": "complex", "scientific": "formula", "slide": "complex"}


def lifecycle(status: Column, archival: Column) -> Column:
    """The lifecycle that a status text stands for, by what it contains."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(archival, "ARCHIVED")
        .when(F.contains(s, F.lit("draft")), "DRAFT")
        .when(F.contains(s, F.lit("disputed")) | F.contains(s, F.lit("conflict")), "DISPUTED")
        .when(F.contains(s, F.lit("superseded")), "SUPERSEDED")
        .when(F.contains(s, F.lit("archive")) | F.contains(s, F.lit("deprecated")), "ARCHIVED")
        .otherwise("ACTIVE")
    )


def trust(status: Column, operational: Column) -> Column:
    """The trust tier that a status text stands for; none outside operational vaults."""
    s = F.lower(F.coalesce(status, F.lit("")))
    reviewed = F.lit(False)
    for word in ("verified", "reviewed", "approved", "active", "curated"):
        reviewed = reviewed | F.contains(s, F.lit(word))
    return F.when(~operational, "UNVERIFIED").when(F.contains(s, F.lit("attested")), "ATTESTED").when(reviewed, "HUMAN_REVIEWED").otherwise("MACHINE_SUPPORTED")


def front_matter(body: Column) -> Column:
    """The ``key: value`` lines between a text's first two ``---`` lines, as a map; the
    last of equal keys counts.  No such block: an empty map."""
    block = F.regexp_extract(body, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda line: line.rlike(r"^[A-Za-z_]+:"))
    pairs = F.transform(lines, lambda line: F.struct(F.regexp_extract(line, r"^([A-Za-z_]+):", 1).alias("k"), F.trim(F.regexp_replace(line, r"^[A-Za-z_]+:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def redacted(payload: Column, most: int) -> Column:
    """A map<string,string> without sensitive keys and absolute paths; values of over
    ``most`` bytes are cut and marked."""
    bare = lambda k: F.lower(F.regexp_replace(k, "[_-]", ""))
    absolute = lambda v: v.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/)")
    safe = F.map_filter(payload, lambda k, v: ~(k.rlike(SENSITIVE_KEY) | bare(k).isin(SENSITIVE_NAMES) | (F.endswith(bare(k), F.lit("path")) & F.coalesce(absolute(v), F.lit(False)))))
    return F.transform_values(safe, lambda _, v: F.when(F.octet_length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…[TRUNCATED]"))).otherwise(v))


#: What an absolute path looks like, and the mark of a value that was cut.
ABSOLUTE = r"^(?:[A-Za-z]:[\\/]|\\\\|/)"
CUT = "…[TRUNCATED]"


def _safe(value, key: str, most: int):
    """A JSON value without what an export leaves out, at any depth; ... if all of it."""
    name = key.replace("_", "").replace("-", "").lower()
    if re.search(SENSITIVE_KEY, key) or name in SENSITIVE_NAMES:
        return ...
    if isinstance(value, str):
        if name.endswith("path") and re.match(ABSOLUTE, value):
            return ...
        return value if len(value.encode()) <= most else value[:most] + CUT
    if isinstance(value, list):
        return [x for x in (_safe(v, "", most) for v in value) if x is not ...]
    if isinstance(value, dict):
        return {k: x for k, x in ((k, _safe(v, k, most)) for k, v in value.items()) if x is not ...}
    return value


def safe_json(payload: Column, most: int) -> Column:
    """A JSON text without sensitive keys and absolute paths at any depth, with keys in
    order; texts of over ``most`` bytes are cut and marked.  What is no JSON is null."""

    def clean(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(_safe(json.loads(v), "", most), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
            except ValueError:
                return None

        return values.map(one)

    clean.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(clean, T.StringType())(payload)


def canonical_json(payload: Column) -> Column:
    """A map<string,string> as JSON with keys in order."""
    entries = F.array_sort(F.map_entries(payload))
    return F.to_json(F.map_from_entries(entries))


def matches_locator(locator: Column, filters: list[dict[str, str]]) -> Column:
    """Whether a map<string,string> holds all pairs of some filter; no filter: true."""
    if not filters:
        return F.lit(True)
    out = F.lit(False)
    for f in filters:
        every = F.lit(True)
        for k, v in f.items():
            every = every & F.coalesce(F.element_at(locator, k) == v, F.lit(False))
        out = out | every
    return out


def complexity(path: Column, media: Column) -> Column:
    """How a document is routed to extraction, by its media type, name and ending."""
    name = F.lower(F.regexp_extract(path, r"[^/]*$", 0))
    out = F.when(F.startswith(media, F.lit("audio/")) | F.startswith(media, F.lit("video/")), "media").when(F.startswith(media, F.lit("image/")), "scanned")
    for word, kind in HINTS.items():
        out = out.when(F.contains(name, F.lit(word)), kind)
    ending = F.regexp_extract(name, r"\.[^.]*$", 0)
    return out.when(ending.isin(SIMPLE), "simple").when(ending == ".pdf", "digital").otherwise("unknown")


def joined_path(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``, with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda t, p: F.when(p == "..", F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(F.array_append(t, p)))
    return F.array_join(walked, "/")
