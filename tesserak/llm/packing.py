"""Pack token sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot-product heuristic: of the examples that fit, the
open sequence takes the one whose demand vector (tokens, segments, loss-bearing
tokens) has the largest dot product with what the sequence has left.  When none
fits whole, the best one is cut to fill it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most, and how many examples wait for a place.

    A sequence that ends on its segments is padded, so their limit belongs to data
    that needs one: instruction data, as pack_examples() takes it.
    """

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    waiting: int = 2048


class Packer:
    """Places examples of one task; memory is bounded by ``limits.waiting``."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence, n = limits, first_sequence, limits.waiting + 1
        self.size, self.loss = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.what: list = [None] * n  # (key, ids, loss flags or None, start, all ids)
        self.n = 0

    def add(self, key, ids: bytes, flags: np.ndarray | None) -> Iterator[tuple]:
        n = len(ids) // 4
        if not n:
            return
        at, step = 0, min(self.limits.tokens, self.limits.loss)
        while flags is None and n - at >= step == self.limits.tokens:  # fills a sequence by itself
            yield self._piece(key, ids[4 * at : 4 * (at + step)], at, n, 0, step)
            self.sequence += 1
            at += step
        if at < n:
            self._put(self.n, (key, ids[4 * at :], None if flags is None else flags[at:], at, n))
            self.n += 1
        if self.n > self.limits.waiting:
            while self.n > self.limits.waiting // 2:
                yield from self._sequence(self.limits.tokens)

    def rest(self) -> Iterator[tuple]:
        """What still waits.  The last tokens go to sequences as long as powers of
        two, which need no padding."""
        while self.n:
            left = int(self.size[: self.n].sum())
            yield from self._sequence(min(self.limits.tokens, 1 << (left.bit_length() - 1)))

    def _put(self, i: int, what: tuple) -> None:
        self.what[i], self.size[i] = what, len(what[1]) // 4
        self.loss[i] = self.size[i] if what[2] is None else int(what[2].sum())

    def _drop(self, i: int) -> None:
        self.n -= 1
        for x in (self.size, self.loss, self.what):
            x[i] = x[self.n]
        self.what[self.n] = None

    def _piece(self, key, ids: bytes, start: int, total: int, offset: int, loss: int) -> tuple:
        return key, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset, loss, ids

    def _sequence(self, tokens: int) -> Iterator[tuple]:
        most, offset, segments, loss = self.limits, 0, 0, 0
        while self.n and offset < tokens and segments < most.segments:
            left, loss_left = tokens - offset, most.loss - loss
            size, bearing = self.size[: self.n], self.loss[: self.n]
            fit = (size <= left) & (bearing <= loss_left)
            dot = size * (left / most.tokens**2) + bearing * (loss_left / most.loss**2) + (most.segments - segments) / most.segments**2
            i = int(np.argmax(np.where(fit, dot, -1.0) if fit.any() else dot))
            key, ids, flags, start, total = self.what[i]
            take = min(len(ids) // 4, left)
            if flags is None:
                take = min(take, loss_left)
                used = take
            else:
                sums = np.cumsum(flags[:take])
                take = int(np.searchsorted(sums, loss_left, side="right"))
                used = int(sums[take - 1]) if take else 0
            if not take:
                break
            yield self._piece(key, ids[: 4 * take], start, total, offset, used)
            offset, segments, loss = offset + take, segments + 1, loss + used
            if 4 * take == len(ids):
                self._drop(i)
            else:
                self._put(i, (key, ids[4 * take :], None if flags is None else flags[take:], start + take, total))
        self.sequence += 1


_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _packed(examples: Iterator[tuple], limits: Limits, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer = Packer(limits, TaskContext.get().partitionId() << 36)
    fields = _FIELDS if with_ids else pa.schema(list(_FIELDS)[:-1])
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)], schema=fields)

    for example in examples:
        rows += packer.add(*example)
        if len(rows) > 4000:
            yield out()
            rows.clear()
    for piece in packer.rest():
        rows.append(piece)
    if rows:
        yield out()


#: For plain texts: every text has a token, so segments never end a sequence.
PLAIN = Limits(segments=Limits.tokens)


def pack_texts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, limits: Limits = PLAIN, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, add ``end_id`` to each and pack them: one row per piece.

    Each task encodes and packs its own rows, so nothing is shuffled and a lost
    task is done again alike.  Every token of a text bears loss.  A null text is
    empty and yields its end id only; repeated rows are packed as often as they
    stand; a null key stays null; other columns are dropped; no rows give none.
    ``with_ids`` adds the piece's ids (unsigned little-endian 32-bit numbers).
    """
    from .bpe import text_encoder

    def run(batches):
        encode, end = text_encoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        yield from _packed(((k, encode(t or "") + end, None) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), limits, with_ids)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Pack rows (doc_id long, ids array<int>, bears array<boolean>): one row per piece.

    For instruction data: ``bears`` marks the tokens that bear loss (an answer's);
    a null array means that all do.  Null or empty ids give no piece.
    """

    def rows(batches):
        for b in batches:
            for k, ids, bears in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "bears")), strict=True):
                yield k, np.asarray(ids or [], dtype="<u4").tobytes(), None if bears is None else np.asarray(bears, dtype=np.int64)

    return examples.select("doc_id", "ids", "bears").mapInArrow(lambda b: _packed(rows(b), limits, with_ids), PIECES + ", ids binary" * with_ids)
