"""License notices by an exact set-similarity join of text blocks with templates.

Tokens are ordered by how many documents hold them, rarest first.  A block that
holds the wanted share of a template's tokens must hold one of the template's
first few in that order (its prefix), must have enough tokens of its own, and
after each match the tokens that are left on both sides must still suffice.
Blocks that pass are checked on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that are looked for besides, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("all-rights-reserved", "all rights reserved no part may be reproduced without permission"),
]


@dataclass(frozen=True)
class Settings:
    """``share``: least part of a template's distinct tokens that a block holds.
    Blocks are runs of ``block`` words (twice the longest template's at least) of
    the whole text, line feeds or not, and of each line.  Runs overlap by the
    longest template, so each stretch of so many words lies in one."""

    share: float = 0.9
    block: int = 64
    templates: tuple = field(default_factory=lambda: tuple(TEMPLATES))


#: A-Z go to a-z; ASCII that is neither letter nor digit separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LINES = bytes(10 if c == 10 else _WORDS[c] for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def token_frequency(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of some tokens stands; bounded by their number."""

    def run(batches):
        for b in batches:
            n: dict[bytes, int] = {}
            for text in b.column("text").to_pylist():
                for w in tokens.intersection(words_of(text)):
                    n[w] = n.get(w, 0) + 1
            yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


class Join:
    """The templates' side of the join: sets in global order and a prefix index."""

    def __init__(self, s: Settings, frequency: dict[bytes, int]):
        tokens = sorted({w for _, t in s.templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.share, self.order = s.share, {w: i for i, w in enumerate(tokens)}
        self.sets, self.prefix = [], {}
        for label, text in s.templates:
            ids = sorted({self.order[w] for w in words_of(text)})
            if not ids:
                continue
            need = max(1, math.ceil(s.share * len(ids) - 1e-9))
            for at, token in enumerate(ids[: len(ids) - need + 1]):
                self.prefix.setdefault(token, []).append((len(self.sets), at))
            self.sets.append((label, frozenset(ids), len(ids), need))
        self.longest = max((len(words_of(t)) for _, t in s.templates), default=1)
        self.block = max(s.block, 2 * self.longest)
        self.least = min((x[3] for x in self.sets), default=1)
        self.first = frozenset(tokens[i] for i in self.prefix)

    def blocks(self, text: str) -> Iterator[list[bytes]]:
        words = words_of(text)
        yield from self._runs(words)
        if len(words) > self.block:
            for line in text.encode().translate(_LINES).split(b"\n"):
                yield from self._runs(line.split())

    def _runs(self, words: list[bytes]) -> Iterator[list[bytes]]:
        if len(words) <= self.block:
            yield words
        else:
            for at in range(0, len(words) - self.longest, self.block - self.longest):
                yield words[at : at + self.block]

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """label -> greatest containment, of templates that reach the share."""
        if self.first.isdisjoint(words):
            return {}
        ids = sorted({self.order[w] for w in words if w in self.order})
        if len(ids) < self.least:  # length filter
            return {}
        met: dict[int, int] = {}
        for here, token in enumerate(ids):
            for number, there in self.prefix.get(token, ()):
                _, _, size, need = self.sets[number]
                so_far = met.get(number, 0)
                if so_far >= 0:  # positional filter
                    met[number] = so_far + 1 if so_far + 1 + min(size - there - 1, len(ids) - here - 1) >= need else -1
        found: dict[str, float] = {}
        have = frozenset(ids)
        for number, n in met.items():
            label, wanted, size, need = self.sets[number]
            if n > 0 and (both := len(wanted & have)) >= need:
                found[label] = max(found.get(label, 0.0), both / size)
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where ``phrase`` stands among ``words``."""
    out, at, n = [], 0, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at : at + n] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


_FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]


def scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    One row per row (doc_id, text), in one pass after the pass that counts the
    templates' tokens.  The templates are a parameter, so their side of the join
    is sent to every task.  ``score`` is the greatest containment found, 1 where a
    base phrase stands, else 0.  A null text has no words, empty label strings,
    null places and score 0.
    """
    tokens = {w for _, t in s.templates for w in words_of(t)}
    shared = docs.sparkSession.sparkContext.broadcast(Join(s, token_frequency(docs, tokens)))
    base = [(words_of(p), f" {p} ".encode(), label) for p, label in BASE.items()]

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                places, labels = [], set()
                if text and len(words) > 2:
                    whole = b" " + b" ".join(words) + b" "
                    for phrase, padded, label in base:
                        if padded in whole:
                            places += _places(words, phrase)
                            labels.add(label)
                found: dict[str, float] = {}
                if not shared.value.first.isdisjoint(words):
                    for block in shared.value.blocks(text):
                        for label, part in shared.value.matches(block).items():
                            found[label] = max(found.get(label, 0.0), part)
                score = 1.0 if labels else max(found.values(), default=0.0)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score))
            columns = zip(*out, strict=True) if out else [[] for _ in _FIELDS]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(n for n, _ in _FIELDS)])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(n, k) for n, k in _FIELDS)]))
