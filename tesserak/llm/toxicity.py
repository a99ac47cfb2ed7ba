"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct words and word beginnings, hashed.  The
machine adds to linear weights an interaction for each two terms, as the dot
product of their factors, so a pair such as an insult with a group's name can
weigh more than its parts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows that are learned from at most (about; the bound
    on what the driver holds).  ``bits``: log2 of the hashed term space, which
    bounds the model that is sent to tasks."""

    sample: int = 16_000
    bits: int = 18
    factors: int = 8
    least_documents: int = 5
    least_apart: float = 4.0
    epochs: int = 10
    rate: float = 0.08
    decay: float = 2e-4
    seed: int = 7


#: A-Z go to a-z; what is neither a letter nor beyond ASCII separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None, mask: int) -> list[int]:
    """Hashes of a whole text's distinct words, of their first 5 bytes, and of such a
    beginning together with "two" or "four" if that many distinct words share it."""
    words = set((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())
    begins = Counter(w[:5] for w in words if len(w) > 5)
    found = words | {b"^" + b for b in begins}
    found |= {b"2^" + b for b, n in begins.items() if n > 1} | {b"4^" + b for b, n in begins.items() if n > 3}
    return sorted({zlib.crc32(w) & mask for w in found})


@dataclass
class Model:
    """P(toxic) = 1 / (1 + exp(-(bias + sum w x + pairs <v_i, v_j> x_i x_j)))."""

    bias: float
    weight: np.ndarray  # by hashed term
    factor: np.ndarray  # by hashed term and factor
    scale: np.ndarray  # x of each hashed term, 0 for those not learned

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        starts, flat = _ragged(rows)
        x = self.scale[flat]
        linear = _sums(self.weight[flat] * x, starts)
        vx = self.factor[flat] * x[:, None]
        total = _sums(vx, starts)
        pairs = 0.5 * (total**2 - _sums(vx**2, starts)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -30, 30)))


def _ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)])
    return np.concatenate(([0], np.cumsum(sizes))), flat


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def _counts(rows: list, width: int) -> np.ndarray:
    """In how many rows each hashed term stands, counted over 1,000 rows at once."""
    return sum((np.bincount(_ragged(rows[at : at + 1000])[1], minlength=width) for at in range(0, len(rows), 1000)), np.zeros(width, np.int64))


def _unexplained_beside(rows: list, labels: np.ndarray, lifted: np.ndarray, model: Model, s: Settings) -> np.ndarray:
    """Which terms hold, among the rows of some ``lifted`` term, more or fewer ones
    than ``model`` and the usual miss in those rows give, by ``least_apart``
    standard deviations."""
    given = np.concatenate([model.scores(rows[at : at + 500]) for at in range(0, len(rows), 500)])
    found = np.zeros(len(lifted), dtype=bool)
    starts, flat = _ragged(rows)
    at = np.flatnonzero(lifted[flat])
    at = at[np.argsort(flat[at], kind="stable")]
    row = np.searchsorted(starts, at, side="right") - 1
    for own in np.split(row, np.flatnonzero(np.diff(flat[at])) + 1):
        if not len(own):
            continue
        usual = (labels - given)[own].mean()
        seen, off, spread = np.zeros(len(lifted), np.int64), np.zeros(len(lifted)), np.zeros(len(lifted))
        for some in (own[i : i + 1000] for i in range(0, len(own), 1000)):
            begins, ids = _ragged([rows[i] for i in some])
            each = lambda x: np.repeat(x, np.diff(begins))  # noqa: B023, E731
            seen += np.bincount(ids, minlength=len(lifted))
            off += np.bincount(ids, each((labels - given)[some] - usual), len(lifted))
            spread += np.bincount(ids, each((given * (1 - given))[some]), len(lifted))
        # half a row is added, so sure scores don't make a small rest stand out
        found |= (seen >= s.least_documents) & (np.abs(off) >= s.least_apart * np.sqrt(spread + 0.5))
    return found


def learn(rows: list, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit a machine to hashed term lists and 0/1 labels (stochastic, with Adagrad).

    Terms in fewer than ``least_documents`` rows are left out, and those whose
    count among ones is less than ``least_apart`` standard deviations from what
    chance gives, unless they are as far from what a machine of the other terms
    gives among the rows of one of these (a group's name, neutral alone, beside an
    insult): then all are learned together.  Pairs of terms that are both neutral
    alone aren't sought.  No rows, or rows of one kind only: a model that gives the
    smoothed share of ones.
    """
    n, width = len(rows), 1 << s.bits
    share = (labels.sum() + 0.1) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    seen = _counts(rows, width)
    ones = _counts([r for r, y in zip(rows, labels, strict=True) if y], width)
    usual = seen * share
    apart = np.abs(ones - usual) / np.sqrt(np.maximum(usual * (1 - share) * (1 - seen / (n + 1)), 1e-9))
    lifted = (seen >= s.least_documents) & (apart >= s.least_apart)
    if n == 0 or labels.min() == labels.max():
        return Model(bias, np.zeros(width), np.zeros((width, s.factors)), lifted.astype(np.float64))
    model = _fitted(rows, labels, bias, lifted, s)
    more = _unexplained_beside(rows, labels, lifted, model, s) & ~lifted
    return _fitted(rows, labels, bias, lifted | more, s) if more.any() else model


def _fitted(rows: list, labels: np.ndarray, bias: float, learned: np.ndarray, s: Settings) -> Model:
    """A machine of the ``learned`` terms alone."""
    n, width = len(rows), len(learned)
    rng = np.random.default_rng(s.seed)
    weight, factor, scale = np.zeros(width), np.zeros((width, s.factors)), learned.astype(np.float64)
    model = Model(bias, weight, factor, scale)
    kept = [np.asarray(r, dtype=np.int64)[scale[np.asarray(r, dtype=np.int64)] > 0] if len(r) else np.zeros(0, np.int64) for r in rows]
    used = np.flatnonzero(scale > 0)
    factor[used] = rng.normal(0, 0.03, (len(used), s.factors))
    g_weight, g_factor, g_bias = np.full(width, 0.1), np.full((width, s.factors), 0.1), 0.1
    for _ in range(s.epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            batch = [kept[i] for i in order[at : at + 64]]
            starts, ids = _ragged(batch)
            x = scale[ids]
            vx = factor[ids] * x[:, None]
            total = _sums(vx, starts)
            score = model.bias + _sums(weight[ids] * x, starts) + 0.5 * (total**2 - _sums(vx**2, starts)).sum(axis=1)
            off = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[order[at : at + 64]]
            row = np.repeat(np.arange(len(batch)), np.diff(starts))
            uniq, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, off[row] * x, len(uniq)) + s.decay * weight[uniq]
            slope = off[row, None] * x[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(inverse, slope[:, f], len(uniq)) for f in range(s.factors)], axis=1) + s.decay * factor[uniq]
            g_weight[uniq] += dw**2
            g_factor[uniq] += dv**2
            weight[uniq] -= s.rate * dw / np.sqrt(g_weight[uniq])
            factor[uniq] -= s.rate * dv / np.sqrt(g_factor[uniq])
            g_bias += off.sum() ** 2
            model.bias -= s.rate * float(off.sum()) / np.sqrt(g_bias)
    return model


def held_out(key) -> F.Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from rows of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks.

    Learns from about ``s.sample`` labelled rows at most, chosen by a hash of the
    id; rows of held_out() and null labels are left out.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = max(1, marked.count())
    dense = 1 << 20
    chosen = marked.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(dense)) < int(dense * min(1.0, s.sample / n)))
    mask = (1 << s.bits) - 1

    def run(batches):
        for b in batches:
            rows = [np.asarray(terms(t, mask), dtype="<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "terms"])

    # at most about s.sample ids and marks, whatever the corpus
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    rows = found.mapInArrow(run, "doc_id long, toxic int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    return learn([np.frombuffer(x, dtype="<i4") for x in rows.column("terms").to_pylist()], np.array(rows.column("toxic").to_pylist(), dtype=np.float64), s)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Reads whole texts.  A null or empty text has no terms and gets the model's
    base rate.  All rows and columns stay; existing columns of those two names
    are replaced.
    """
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mask = (1 << s.bits) - 1
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            names, given = b.schema.names, []
            texts = b.column(names.index("text"))
            for at in range(0, b.num_rows, 500):
                given.append(shared.value.scores([terms(t, mask) for t in texts.slice(at, 500).to_pylist()]))
            got = np.concatenate(given or [np.zeros(0)])
            yield pa.record_batch([*b.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
