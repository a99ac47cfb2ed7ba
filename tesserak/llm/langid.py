"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent n-grams.  A document's
ranking is compared with each profile by the out-of-place distance: how far each
n-gram lies from its rank there, or the greatest distance if it is absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .toxicity import held_out


@dataclass(frozen=True)
class Settings:
    """``ranks``: n-grams of a profile.  ``sample``: about how many texts a language
    is learned from at most, all of them if it is None; profiles grow with the number of
    languages alone.
    A text is near its language if its distance is no more than ``margin`` beyond
    what the share ``usual`` of learned texts of its size keeps to."""

    ranks: int = 300
    sample: int | None = None
    usual: float = 0.99
    margin: float = 0.15


#: Characters of text that are counted at once; a longer text is counted alone.
CHUNK = 1 << 20


@lru_cache(1)
def _letter_numbers() -> np.ndarray:
    """12-bit numbers of all letters of Unicode by code point; 0 if it isn't one."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=len(points))
    return np.where(letter, np.where(points < 2048, points, 2048 + points % 2048), 0).astype(np.uint16)


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers, 0 for one gap between words, and each one's text)."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in low])
    letter = _letter_numbers()[codes].astype(np.int64)
    keep = np.ones(len(letter), dtype=bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0)
    return letter[keep], np.searchsorted(ends, np.flatnonzero(keep), side="right")


def ranked(texts: list[str | None], ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank from 0, count) of each text's most frequent n-grams of one
    to three letters, with gaps between words as letters.  Ties go to the smaller n-gram."""
    letter, text = _letters(texts)
    grams = [letter | (text << 40)]
    grams[0] = grams[0][letter > 0]
    if len(letter) > 1:
        a, b = letter[:-1], letter[1:]
        same = text[:-1] == text[1:]
        grams.append(((1 << 38) | (a << 12) | b | (text[1:] << 40))[same])
        if len(letter) > 2:
            same = (text[:-2] == text[2:]) & (b[:-1] > 0)
            grams.append(((2 << 38) | (a[:-1] << 24) | (b[:-1] << 12) | letter[2:] | (text[2:] << 40))[same])
    keys = np.sort(np.concatenate(grams))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((new, [len(keys)]))) if len(keys) else new
    keys = keys[new]
    owner = keys >> 40
    order = np.argsort((owner << 30) | ((1 << 30) - 1 - np.minimum(counts, (1 << 30) - 1)), kind="stable")
    owner, keys, counts = owner[order], keys[order], counts[order]
    starts = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - starts[owner]
    top = rank < ranks
    return owner[top], keys[top] & ((1 << 40) - 1), rank[top], counts[top]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # sorted n-grams of any profile
    ranks: np.ndarray  # by n-gram and language; Settings.ranks if absent
    far: int
    #: greatest usual distance of a text with 2^i to 2^(i+1) - 1 ranked n-grams
    bounds: np.ndarray = field(default_factory=lambda: np.ones(32))

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language or ``und``, score 0 to 1, distance 0 to 1, size) of each text.

        The distance is the mean over its n-grams, as a share of the greatest; the
        size is the base-2 logarithm of how many there are."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.zeros(len(texts), np.int64)
        owner, gram, rank, _ = ranked(texts, self.far)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        there = self.ranks[at]
        away = np.where(known[:, None] & (there < self.far), np.abs(there - rank[:, None]), self.far)
        total = np.stack([np.bincount(owner, away[:, j], len(texts)) for j in range(len(self.languages))], axis=1)
        held = np.bincount(owner, minlength=len(texts))
        has, best = held > 0, total.argmin(axis=1)
        near = np.sort(total, axis=1)
        margin = 1 - near[:, 0] / np.maximum(near[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        distance = np.where(has, near[:, 0] / (np.maximum(held, 1) * self.far), 1.0)
        return [self.languages[i] if h else "und" for i, h in zip(best, has, strict=True)], np.where(has, np.clip(margin, 0, 1), 0.0), distance, np.log2(np.maximum(held, 1)).astype(np.int64)

    def usual(self, langs: list[str], distance: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether texts have a language and are as near to it as texts usually are."""
        return (distance <= self.bounds[size]) & np.array([x != "und" for x in langs], dtype=bool)


def fit(docs: DataFrame, s: Settings = Settings()) -> Profiles:
    """Profiles of ``docs(doc_id, text, lang)``, without rows of held_out().

    All texts are counted, unless the settings name a sample, which a hash of their id
    chooses; counting them and merging the counts run in Spark, and the driver gets the
    profiles alone.
    Every language that stands in ``docs`` is learned.  Distances of the same texts
    give the usual bounds by size.  Rows with a null id or language are left out.
    No rows: no languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = rows if s.sample is None else _sampled(rows, s.sample)

    def count(batches):
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for at in range(0, len(texts), 100):
                by = {}
                owner, gram, _, n = ranked(texts[at : at + 100], 1 << 30)
                for lang in set(langs[at : at + 100]):
                    mine = np.array([x == lang for x in langs[at : at + 100]])[owner]
                    uniq, inverse = np.unique(gram[mine], return_inverse=True)
                    by[lang] = (uniq, np.bincount(inverse, n[mine], len(uniq)).astype(np.int64))
                for lang, (g, n) in by.items():
                    yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= s.ranks)
    got = top.select("lang", "gram", "rank").collect()
    languages = sorted({r["lang"] for r in got})
    grams = np.array(sorted({r["gram"] for r in got}), dtype=np.int64)
    ranks = np.full((len(grams), len(languages)), s.ranks, dtype=np.int64)
    for r in got:
        ranks[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["rank"] - 1
    return _bounded(chosen, Profiles(languages, grams, ranks, s.ranks), s)


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    shares = {r["lang"]: min(1.0, most / r["count"]) for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")] if shares else F.lit(0.0)
    dense = 1 << 20
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(dense)) < share * dense)


def _bounded(chosen: DataFrame, profiles: Profiles, s: Settings) -> Profiles:
    """``profiles`` with the distances that learned texts keep to, by size."""
    shared = chosen.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 100):
                langs, _, distance, size = shared.value.nearest(texts[at : at + 100])
                named = np.array([x != "und" for x in langs], dtype=bool)
                yield pa.record_batch([pa.array(size[named]), pa.array(distance[named])], ["size", "distance"])

    if not profiles.languages:
        return profiles
    held = chosen.select("text").mapInArrow(run, "size long, distance double")
    bounds, rows = np.ones(32), held.groupBy("size").agg(F.percentile_approx("distance", s.usual, 1000).alias("bound"), F.count("*").alias("n")).collect()
    for r in sorted(rows, key=lambda r: r["size"]):
        if r["n"] >= 50:  # a size that is seldom met takes the bound of the one below
            bounds[r["size"] :] = min(1.0, r["bound"] + s.margin)
    return replace(profiles, bounds=bounds)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``distance`` and ``usual``: the nearest
    profile of each whole text.

    ``score`` is one minus the nearest distance over the second nearest; ``distance``
    is the nearest, from 0 to 1; ``usual`` says that it is no greater than those of
    learned texts of its size.  A text that is null or has no letters is ``und``
    with score 0 and not usual; ties go to the first language by name.  All rows
    and columns stay, repeated rows and null ids too; existing columns of those
    names are replaced.  No rows: none.
    """
    kept = docs.drop("lang_pred", "score", "distance", "usual")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType()), T.StructField("usual", T.BooleanType())])

    def run(batches):
        for b in batches:
            names, langs, scores, distances, usual, some, size = b.schema.names, [], [], [], [], [], 0
            for text in [*b.column(names.index("text")).to_pylist(), ...]:
                if text is not ...:
                    some.append(text)
                    size += len(text or "")
                if some and (text is ... or size > CHUNK or len(some) == 2000):
                    lang, score, distance, held = shared.value.nearest(some)
                    langs += lang
                    scores.append(score)
                    distances.append(distance)
                    usual.append(shared.value.usual(lang, distance, held))
                    some, size = [], 0
            numbers = [pa.array(np.concatenate(x or [np.zeros(0)])) for x in (scores, distances)]
            yield pa.record_batch([*b.columns, pa.array(langs, pa.string()), *numbers, pa.array(np.concatenate(usual or [np.zeros(0, bool)]))], [*names, "lang_pred", "score", "distance", "usual"])

    return kept.mapInArrow(run, schema)
