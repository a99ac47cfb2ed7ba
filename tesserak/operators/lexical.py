"""A positional inverted index over documents and units, and cover-density rank.

Occurrences are written once, packed by term over many documents, in folders by hash of
the term and sorted within, so a query reads its terms' folders and, of these, the row
groups that hold its terms.  A word of a body is there once, whatever units it belongs to.
Postings (term, doc_id, unit, field, places) are made of them for documents only that hold
a query's rarest terms, and ranks for those that can still be among the k best: counts and
outermost places bound a rank from both sides.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .chunking import spans, structural_units
from .graph import cut

#: Weights of a document's and a unit's fields, and of symbols where plain
#: terms don't match.
DOCUMENT = {"external_id": 32.0, "alias": 28.0, "title": 20.0, "path": 24.0, "body": 2.0}
UNIT = {"heading": 12.0, "unit": 8.0, "text": 1.0}
SYMBOL = {"document": 26.0, "unit": 10.0}
#: Weights of the classes A to D of a place, and what pieces of symbol text are.
CLASS_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
SYMBOL_CLASS = {"external_id": "A", "alias": "A", "title": "B", "path": "B", "body": "D", "heading": "A", "unit": "B", "text": "D"}
CLASSES = "DCBA"
#: What a match is called, in order of precedence.
REASONS = {
    "external_id": "lexical:external-id-terms",
    "alias": "lexical:alias-terms",
    "path": "lexical:path-terms",
    "title": "lexical:title-terms",
    "symbol": "lexical:symbol-terms",
    "heading": "lexical:heading-terms",
    "unit": "lexical:unit-terms",
    "body": "lexical:body-terms",
}
#: The number of a document's own fields; units have their place in the text.
OWN = -1

_INVERSE = np.array([1 / CLASS_WEIGHT[c] for c in CLASSES])


def cover_density(places: list[np.ndarray]) -> float:
    """The rank of a field by the places of each term (4 x position + class).

    Over all least stretches of text that hold every term: the mean weight of the
    places inside (harmonic), over one more than the number of other words there.
    """
    every = np.sort(np.concatenate(places))
    position, sums = every >> 2, np.concatenate(([0.0], np.cumsum(_INVERSE[every & 3])))
    start = np.full(len(every), np.iinfo(np.int64).max)
    for own in places:
        own = np.sort(own) >> 2
        last = np.searchsorted(own, position, side="right") - 1
        start = np.minimum(start, np.where(last >= 0, own[last], -1))
    ends = np.flatnonzero((start >= 0) & (np.diff(start, prepend=-1) > 0))
    first = np.searchsorted(position, start[ends], side="left")
    held = ends - first + 1
    noise = position[ends] - start[ends] - (held - 1)
    return float(((held / (sums[ends + 1] - sums[first])) / (1 + noise)).sum())


#: The fields by number, and which words of a piece of text a spot stands for.
FIELDS = [*DOCUMENT, *UNIT]
BOTH, PLAIN, SYMBOLS = range(3)
#: Added to positions in symbol text, which begin before 0; occurrences that
#: are packed and bytes that are unpacked at once; rows that are handed on at once; rarest
#: terms that lead to candidates.
BASE, CHUNK, AT_ONCE, ROWS, LEADS = 1 << 26, 500_000, 1 << 20, 20_000, 4
#: Bits of a sieve for each pair in it and at most in all (16 MB), bits of a
#: page of it, bits that each pair sets.
SIEVE, SIEVE_MOST, PAGE, SET = 16, 1 << 27, 1 << 15, 4

_PACKED = "bucket int, term string, plain int, symbols int, spots binary"
_SPOTS = "term string, doc_id long, slot array<int>, gap array<int>, place array<int>, shift array<int>"
_POSTING = "term string, doc_id long, unit int, field string, n int, first int, last int, places array<int>"
_WORD = re.compile(r"[^\W_]+")
_AROUND = ".,;:!?()[]\"'*`#-"
_LOWER_UPPER, _UPPER_WORD, _PLAIN = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"), re.compile("[A-Za-z0-9]+")


def words(value: str) -> list[str]:
    """As functions.text.tokens() gives them."""
    return _WORD.findall(value.lower())


def symbol_words(value: str) -> list[str]:
    """The words of functions.text.symbol_text()."""
    return [w.lower() for w in _PLAIN.findall(_UPPER_WORD.sub(r"\1 \2", _LOWER_UPPER.sub(r"\1 \2", value)))]


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): signed numbers, seven bits a byte, small ones first."""
    bits = ((values << 1) ^ (values >> 63)).astype(np.uint64)
    most = max(1, -(-int(bits.max()).bit_length() // 7)) if len(bits) else 1
    size = np.ones(len(bits), np.int8)
    for k in range(1, most):
        size += bits >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, at = np.arange(len(values)), ends - size
    for k in range(most):
        more = size[left] > k + 1
        out[at[left] + k] = ((bits[left] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        left = left[more]
    return out, ends


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, end of each) of such bytes."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    k = np.arange(len(data)) - np.repeat(starts, ends - starts)
    bits = np.bitwise_or.reduceat((data & 127).astype(np.uint64) << (7 * k).astype(np.uint64), starts) if len(ends) else np.zeros(0, np.uint64)
    return (bits >> np.uint64(1)).astype(np.int64) ^ -(bits & np.uint64(1)).astype(np.int64), ends


class _Pieces(dict):
    """Numbers of pieces without white space, and the words of each, plain and symbols'."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.term, self.kind, self.ends = array("q"), array("b"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        bare = piece.strip(_AROUND)
        if bare.isascii() and bare.isalnum() and bare[1:] == bare[1:].lower():  # most pieces: one word, of both kinds
            both = [(bare.lower(), BOTH)]
        else:
            plain, symbols = words(piece), symbol_words(piece)
            both = [(w, BOTH) for w in plain] if plain == symbols else [(w, PLAIN) for w in plain] + [(w, SYMBOLS) for w in symbols]
        for w, kind in both:
            self.term.append(self.terms.setdefault(w, len(self.terms)))
            self.kind.append(kind)
        self.ends.append(len(self.term))
        self[piece] = len(self)
        return self[piece]


class _Spots:
    """Occurrences in the making: (term, doc_id, slot, gap, place, place in symbol text).

    ``slot`` is 32 x (unit + 1) + 4 x field + which words it stands for; ``gap`` is how
    far the unit's section is before it, 0 without one.  An occurrence in a body is
    there once, for the body, its block and its section, and for both kinds of words
    where these are the same: a rank knows distances only, and these agree.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, _Pieces()
        self.pieces, self.texts = array("q"), array("q")

    def add(self, doc_id: int, unit: int, gap: int, field: str, value: str, after: bool = False, first: int | None = None, last: int | None = None) -> None:
        """Add a text.  Its words go on from the text before if it comes ``after`` that.
        Symbols' places do unless their run begins after ``first`` here, or begins here
        and ends at ``last``."""
        held = len(self.pieces)
        self.pieces.extend(map(self.known.__getitem__, value.split()))
        turn = 1 if first is not None else 2 if last is not None else 0
        self.texts.extend((len(self.pieces) - held, doc_id, 32 * (unit + 1) + 4 * FIELDS.index(field), gap, not after, turn, first or last or 0))

    def __len__(self) -> int:
        return len(self.pieces)

    def _rows(self) -> np.ndarray:
        """(term, doc_id, slot, gap, place, place in symbol text), as they came."""
        texts = np.frombuffer(self.texts, np.int64).reshape(-1, 7)
        ends, pieces = np.frombuffer(self.known.ends, np.int64), np.frombuffer(self.pieces, np.int64)
        n = ends[pieces + 1] - ends[pieces]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(upto[-1]) + np.repeat(ends[pieces] - upto[:-1], n)
        term, kind = np.frombuffer(self.known.term, np.int64)[at], np.frombuffer(self.known.kind, np.int8)[at].astype(np.int64)
        bounds = upto[np.concatenate(([0], np.cumsum(texts[:, 0])))]
        size, starts = np.diff(bounds), bounds[:-1]
        p, q = (np.concatenate(([0], np.cumsum(kind != other))) for other in (SYMBOLS, PLAIN))
        begins = np.flatnonzero(texts[:, 4])
        before = p[starts[begins]][np.cumsum(texts[:, 4]) - 1]
        runs = np.flatnonzero(texts[:, 5])
        anchor = np.where(texts[runs, 5] == 1, starts[runs], np.append(starts[runs[1:]], bounds[-1]))
        shift = (texts[runs, 6] - q[anchor])[np.cumsum(texts[:, 5] > 0) - 1]
        doc, slot, gap, before, shift = (np.repeat(x, size) for x in (texts[:, 1], texts[:, 2], texts[:, 3], before, shift))
        return np.stack((term, doc, slot + kind, gap, p[1:] - before, q[1:] + shift), axis=1)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows by bucket and term: differences from occurrence to occurrence, in few bytes."""
        if not len(self):
            return
        rows, names = self._rows(), list(self.known.terms)
        if not len(rows):
            return
        bucket = np.array([crc32(w.encode()) % self.buckets for w in names], np.int64)
        turn = np.empty(len(names), np.int32)
        turn[np.argsort(bucket, kind="stable")] = np.arange(len(names), dtype=np.int32)
        rows = rows[np.argsort(turn[rows[:, 0]], kind="stable")]
        term, values = rows[:, 0], rows[:, 1:].copy()
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        values[:, 4] -= values[:, 3]
        change = np.diff(values, axis=0, prepend=np.zeros((1, 5), np.int64))
        change[starts] = values[starts]
        new = np.diff(values[:, 0], prepend=values[0, 0] - 1) != 0
        new[starts] = True
        change[new, 3], change[:, 4] = values[new, 3], values[:, 4]
        data, ends = varints(change.ravel())
        offsets = np.concatenate(([0], ends[5 * np.append(starts[1:], len(term)) - 1]))
        held = [np.add.reduceat((values[:, 1] % 4 != other).astype(np.int32), starts) for other in (SYMBOLS, PLAIN)]
        for at in range(0, len(starts), ROWS):
            size = min(ROWS, len(starts) - at)
            cut_ = offsets[at : at + size + 1]
            own = pa.py_buffer((cut_ - cut_[0]).astype(np.int32)), pa.py_buffer(data[cut_[0] : cut_[-1]])
            spots = pa.Array.from_buffers(pa.binary(), size, [None, *own])
            which = term[starts[at : at + size]]
            columns = pa.array(bucket[which].astype(np.int32)), pa.array([names[i] for i in which], pa.string()), *(pa.array(h[at : at + size], pa.int32()) for h in held), spots
            yield pa.record_batch(list(columns), ["bucket", "term", "plain", "symbols", "spots"])


def _packed(batches, add, buckets: int):
    """Rows by bucket and term of all rows of some batches; ``add`` puts one into _Spots."""
    spots = _Spots(buckets)
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] is not None:
                add(spots, *row)
            if len(spots) > CHUNK:
                yield from spots.batches()
                spots = _Spots(buckets)
    yield from spots.batches()


def _add_document(spots: _Spots, doc_id: int, *fields: str | None) -> None:
    own = dict(zip(DOCUMENT, (f or "" for f in fields), strict=True))
    body = own.pop("body").replace("\r\n", "\n").replace("\r", "\n").strip()
    for i, (field, value) in enumerate(own.items()):  # symbols of these end where the body's begin
        spots.add(doc_id, OWN, 0, field, value, last=None if i else 0)
    owner, section = {}, 0
    for order, _, kind, path, first, last, _ in spans(body):
        if kind == "SECTION":
            section = order
        elif order:
            for line in range(first, last + 1):
                owner[line] = (order, order - section if path else 0)
    for n, line in enumerate(body.split("\n"), 1):
        spots.add(doc_id, *owner.get(n, (OWN, 0)), "body", line, after=n > 1, first=None if n > 1 else 0)


def _add_name(spots: _Spots, doc_id: int, unit: int, before: int, heading: str, name: str) -> None:
    """A unit's heading and name, whose symbols stand right before those of its text."""
    spots.add(doc_id, unit, 0, "heading", heading, last=before)
    spots.add(doc_id, unit, 0, "unit", name)


@lru_cache(1 << 17)
def _symbols(piece: str) -> int:
    return len(symbol_words(piece))


def counted_units(docs: DataFrame) -> DataFrame:
    """Structural units with the number of symbols' words ``before`` each in its text."""
    return structural_units(docs.select("doc_id", "title", "body"), lambda line: sum(map(_symbols, line.split())))


def packed(docs: DataFrame, names: DataFrame, buckets: int) -> DataFrame:
    """(bucket, term, plain, symbols, spots): occurrences in documents (doc_id,
    external_id, aliases, title, path, body) and in units' rows (doc_id, unit, before,
    heading, name), some hundred documents a row.  Each task packs its own documents,
    so nothing is shuffled, and a term that stands everywhere is no single task's."""
    own = docs.select(F.col("doc_id").cast("long"), *[(F.concat_ws(" ", "aliases") if f == "alias" else F.col(f)).alias(f) for f in DOCUMENT])
    inner = names.select("doc_id", "unit", "before", "heading", "name")
    return own.mapInArrow(lambda b: _packed(b, _add_document, buckets), _PACKED).unionByName(inner.mapInArrow(lambda b: _packed(b, _add_name, buckets), _PACKED))


def _since(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``starts``, of which the first is 0."""
    total = np.cumsum(x)
    return total - np.repeat(total[starts] - x[starts], np.diff(starts, append=len(x)))


def _bits(terms: list[str], doc_ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each pair sets in a sieve of ``bits``, a power of two."""
    x = np.array([crc32(t.encode()) for t in terms], np.uint64) ^ (doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(SET, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _set_bits(batches, bits: int):
    for b in batches:
        at = np.unique(_bits(b.column("term").to_pylist(), b.column("doc_id").to_numpy(zero_copy_only=False), bits))
        yield pa.record_batch([pa.array((at // PAGE).astype(np.int32)), pa.array((at % PAGE).astype(np.int32))], ["page", "at"])


def _page(rows: pa.Table) -> pa.Table:
    held = np.zeros(PAGE, bool)
    held[rows.column("at").to_numpy()] = True
    return pa.table({"page": rows.column("page").slice(0, 1), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})


def sieve(pairs: DataFrame) -> np.ndarray:
    """Bits by which a task passes over most postings that aren't among rows (term,
    doc_id), before anything is shuffled: 2 bytes a pair, 16 MB at most.  What it lets by
    besides (few in a thousand, more where the most is reached) is for a join to drop."""
    bits = min(SIEVE_MOST, max(PAGE, 1 << (SIEVE * pairs.count()).bit_length()))
    set_ = pairs.select("term", "doc_id").mapInArrow(partial(_set_bits, bits=bits), "page int, at int").distinct()
    out = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for page, held in set_.groupBy("page").applyInArrow(_page, "page int, held binary").collect():
        out[page] = np.frombuffer(held, np.uint8)
    return out.ravel()


def _among(held: np.ndarray, terms: list[str], doc_ids: np.ndarray) -> np.ndarray:
    at = _bits(terms, doc_ids, 8 * len(held))
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _unpack(batches, held: np.ndarray | None = None):
    """Rows by term and document of packed rows (term, spots, …) that a sieve lets by;
    other columns stay."""
    for b in batches:
        spots, terms = b.column("spots"), b.column("term").to_pylist()
        size = np.cumsum([len(x) for x in spots.to_pylist()])
        cuts = np.unique(np.searchsorted(size, np.arange(AT_ONCE, size[-1] if len(size) else 0, AT_ONCE)))
        for first, last in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            part = spots.slice(first, last - first).to_pylist()
            if not part:
                continue
            values, ends = from_varints(np.frombuffer(b"".join(part), np.uint8))
            values = values.reshape(-1, 5)
            bounds = np.searchsorted(ends, np.cumsum([len(x) for x in part]), side="right") // 5
            starts = np.concatenate(([0], bounds[:-1]))
            row = np.repeat(np.arange(first, last), bounds - starts)
            doc, slot, gap = (_since(values[:, i], starts) for i in range(3))
            new = np.diff(doc, prepend=doc[0] - 1) != 0
            new[starts] = True
            groups = np.flatnonzero(new)
            place = _since(values[:, 3], groups)
            columns, size_ = (slot, gap, place, values[:, 4]), np.diff(np.append(groups, len(doc)))
            if held is not None:
                let_by = _among(held, [terms[i] for i in row[groups]], doc[groups])
                columns, groups, size_ = [x[np.repeat(let_by, size_)] for x in columns], groups[let_by], size_[let_by]
            offsets = pa.array(np.concatenate(([0], np.cumsum(size_))).astype(np.int32))
            kept = [(n, b.column(n).take(pa.array(row[groups]))) for n in b.schema.names if n != "spots"]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in columns]
            names = [n for n, _ in kept] + ["doc_id", "slot", "gap", "place", "shift"]
            yield pa.record_batch([*(c for _, c in kept), pa.array(doc[groups]), *lists], names)


def _expand(batches):
    """Postings of rows by term and document: by unit and field."""
    classes = [CLASSES.index(SYMBOL_CLASS[f]) for f in FIELDS]
    for b in batches:
        out = []
        for term, doc_id, slots, gaps, places, shifts in zip(*(b.column(c).to_pylist() for c in ("term", "doc_id", "slot", "gap", "place", "shift")), strict=True):
            held: dict[tuple[int, str], list[int]] = {}
            for slot, gap, place, shift in zip(slots, gaps, places, shifts, strict=True):
                unit, number, kind = slot // 32 - 1, slot % 32 // 4, slot % 4
                field = FIELDS[number]
                inner = field == "body" and unit != OWN
                homes = [OWN, unit, *([unit - gap] if gap else [])] if inner else [unit]
                for home in homes:
                    if kind != SYMBOLS:
                        held.setdefault((home, "text" if inner and home != OWN else field), []).append(4 * place)
                    if kind != PLAIN:
                        held.setdefault((home, "symbol"), []).append(4 * (place + shift + BASE) + classes[number])
            out += [(term, doc_id, unit, field, len(p), min(p) >> 2, max(p) >> 2, p) for (unit, field), p in held.items()]
        if out:
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["term", "doc_id", "unit", "field", "n", "first", "last", "places"])


def _homes(batches):
    """(term, doc_id, unit, symbol) of such rows: where their postings are, without places."""
    for b in batches:
        slots = b.column("slot")
        row = np.repeat(np.arange(b.num_rows), np.diff(slots.offsets.to_numpy()))
        slot, gap = slots.flatten().to_numpy().astype(np.int64), b.column("gap").flatten().to_numpy()
        unit, kind = slot // 32 - 1, slot % 4
        inner = (slot % 32 // 4 == FIELDS.index("body")) & (unit != OWN)
        section = inner & (gap > 0)
        row, unit, kind = (np.concatenate(x) for x in ((row, row[inner], row[section]), (unit, np.full(inner.sum(), OWN), (unit - gap)[section]), (kind, kind[inner], kind[section])))
        both = [np.stack((row[kind != other], unit[kind != other], np.full((kind != other).sum(), symbol)), axis=1) for other, symbol in ((SYMBOLS, 0), (PLAIN, 1))]
        row, unit, symbol = np.unique(np.concatenate(both), axis=0).T
        at = pa.array(row)
        yield pa.record_batch([b.column("term").take(at), b.column("doc_id").take(at), pa.array(unit.astype(np.int32)), pa.array(symbol.astype(bool))], ["term", "doc_id", "unit", "symbol"])


def postings(spots: DataFrame) -> DataFrame:
    """Postings of rows by term and document, with ``symbol``; not yet one for each key."""
    return spots.mapInArrow(_expand, _POSTING).withColumn("symbol", F.col("field") == "symbol")


@dataclass(frozen=True)
class Index:
    """A written index: packed occurrences by bucket, and which units are containers."""

    path: str
    buckets: int = 64

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, units: DataFrame | None = None, part: str = "") -> Index:
        """Write everything, over what was in ``part``: units first, whose names are then
        read from there.  ``units`` of ``docs`` are made here unless they are given with
        what is ``before`` them."""
        made = units if units is not None and "before" in units.columns else counted_units(docs)
        held = made.select("doc_id", F.col("structural_order").alias("unit"), "unit_key", "container", "before", F.array_join("heading_path", " ").alias("heading"), F.concat_ws(" ", "unit_key", "unit_type").alias("name"))
        held.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/units{part}")
        names = docs.sparkSession.read.parquet(f"{self.path}/units{part}").where("unit > 0")
        dealt = packed(docs, names, self.buckets).sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings{part}")
        return self

    def read(self, spark: SparkSession, asked: DataFrame) -> DataFrame:
        """The packed rows in the folders of rows (term): at most ``buckets`` numbers are
        collected to name them."""
        wanted = [r[0] for r in asked.select(self.bucket(F.col("term"))).distinct().collect()]
        return spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(wanted))

    def terms(self, spark: SparkSession, asked: DataFrame) -> DataFrame:
        """(term, symbol, rows): how often the terms of rows (term) occur, if they do."""
        held = self.read(spark, asked).select("term", "plain", "symbols").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("plain").alias("plain"), F.sum("symbols").alias("symbols"))
        both = F.array(*[F.struct(F.lit(symbol).alias("symbol"), F.col(c).alias("rows")) for symbol, c in ((False, "plain"), (True, "symbols"))])
        return held.select("term", F.inline(both)).where("rows > 0")

    def spots(self, spark: SparkSession, asked: DataFrame, held: np.ndarray | None = None) -> DataFrame:
        """Rows by term and document of the terms of rows (term), which the words of the
        queries bound, so they go to every task; of these what a sieve lets by."""
        rows = self.read(spark, asked).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        return rows.select("term", "spots").mapInArrow(partial(_unpack, held=held), _SPOTS)

    def units(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/units").drop("before", "heading", "name")


@dataclass(frozen=True)
class Segmented(Index):
    """An index that grows by numbered segments of document versions.

    A segment written again replaces itself, so a batch may be replayed.  Of a
    document the greatest version counts, in whichever segment it came; its occurrences
    elsewhere are passed over.
    """

    def add(self, number: int, versions: DataFrame) -> None:
        """Write a batch of rows (doc_id, version, deleted, external_id, aliases, title,
        path, body) as segment ``number``."""
        part = f"/segment={number}"
        newest = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc("deleted"), F.xxhash64("title", "body"))
        last = versions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        last.select("doc_id", "version", "deleted").write.mode("overwrite").parquet(f"{self.path}/live{part}")
        kept = last.where("not deleted")
        self.write(kept, part=part)

    def live(self, spark: SparkSession) -> DataFrame:
        """(doc_id, segment): where each document's newest version is."""
        held = spark.read.parquet(f"{self.path}/live").groupBy("doc_id").agg(F.max(F.struct("version", "segment", "deleted")).alias("last"))
        return held.where("not last.deleted").select("doc_id", F.col("last.segment").alias("segment"))

    def spots(self, spark: SparkSession, asked: DataFrame, held: np.ndarray | None = None) -> DataFrame:
        rows = self.read(spark, asked).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        found = rows.select("segment", "term", "spots").mapInArrow(partial(_unpack, held=held), "segment int, " + _SPOTS)
        return found.join(self.live(spark), ["doc_id", "segment"], "left_semi").drop("segment")

    def units(self, spark: SparkSession) -> DataFrame:
        return super().units(spark).join(self.live(spark), ["doc_id", "segment"], "left_semi").drop("segment")


def _bounds(rows: DataFrame) -> DataFrame:
    """Bounds (low, high) on the rank of each (query_id, doc_id) from counts and outermost
    places alone.  Every term stands in a stretch of first to last, and there are no
    more least stretches than places."""
    weights = F.create_map(*[x for f, w in {**DOCUMENT, **UNIT}.items() for x in (F.lit(f), F.lit(w))])
    per = rows.groupBy("query_id", "symbol", "doc_id", "unit", "field", "m").agg(F.count("*").alias("terms"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).where("terms = m")
    symbol = F.when(F.col("unit") == OWN, SYMBOL["document"]).otherwise(SYMBOL["unit"])
    weight = F.when(F.col("field") == "symbol", symbol).otherwise(weights[F.col("field")])
    least = F.when(F.col("field") == "symbol", 0.0).otherwise(weight * CLASS_WEIGHT["D"] / (F.col("last") - F.col("first") - F.col("m") + 2))
    most = weight * F.when(F.col("field") == "symbol", CLASS_WEIGHT["A"]).otherwise(CLASS_WEIGHT["D"]) * (F.col("n") - F.col("m") + 1)
    by_unit = per.groupBy("query_id", "doc_id", "unit").agg(F.sum(least).alias("low"), F.sum(most).alias("high"))
    own = F.col("unit") == OWN
    # the whole document is a unit too: its heading and text are a part of its own fields
    both = lambda c: F.coalesce(F.max(F.when(own, F.col(c))), F.lit(0.0))
    return by_unit.groupBy("query_id", "doc_id").agg((both("low") + F.coalesce(F.max(F.when(~own, F.col("low"))), F.lit(0.0))).alias("low"), (2 * both("high") + F.coalesce(F.max(F.when(~own, F.col("high"))), F.lit(0.0))).alias("high"))


def _ranks(batches):
    """Ranks by field of rows (query_id, symbol, doc_id, unit, m, hits)."""
    for b in batches:
        out = []
        for query, symbol, doc_id, unit, m, hits in zip(*(b.column(c).to_pylist() for c in ("query_id", "symbol", "doc_id", "unit", "m", "hits")), strict=True):
            held: dict[str, list[np.ndarray]] = {}
            terms: dict[str, set] = {}
            for h in hits:
                held.setdefault(h["field"], []).append(np.array(h["places"], dtype=np.int64))
                terms.setdefault(h["field"], set()).add(h["term"])
            ranks = {f: cover_density(p) for f, p in held.items() if len(p) == m}
            out.append((query, symbol, doc_id, unit, list(ranks.items())))
            if unit == OWN and not symbol and len(terms.get("title", set()) | terms.get("body", set())) == m:
                out.append((query, symbol, doc_id, 0, [(u, ranks[f]) for u, f in (("heading", "title"), ("text", "body")) if f in ranks]))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.float64())]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["query_id", "symbol", "doc_id", "unit", "ranks"])


def search(index: Index, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, raw_score, reason, unit): the k best documents of each query.

    ``queries``: (query_id, query); ``allowed``: (doc_id) that may be found.  A document
    matches if its fields together hold all distinct terms of the query, or its symbol
    text all words of the query's, or one of its units does.  Its score is the weighted
    sum of the cover densities of its fields and its best unit's; ``unit`` is that
    unit's key.  Queries without a term find nothing; ties go to the smaller doc_id.
    """
    spark = queries.sparkSession
    words = F.explode(F.array(F.struct(F.lit(False).alias("symbol"), F.array_distinct(text.tokens(F.col("query"))).alias("terms")), F.struct(F.lit(True).alias("symbol"), F.array_distinct(text.tokens(text.symbol_text(F.col("query")))).alias("terms")))).alias("w")
    # what queries ask for and what they may find is small beside the postings; written,
    # its size is known to the planner, which then needn't shuffle postings
    asked = cut(queries.select("query_id", words).select("query_id", "w.symbol", F.size("w.terms").alias("m"), F.explode("w.terms").alias("term")))
    # the rarest terms of a query lead to its candidates; a term that nothing holds ends it
    each = Window.partitionBy("query_id", "symbol")
    counted = asked.join(index.terms(spark, asked), ["term", "symbol"], "left").withColumn("least", F.min(F.coalesce("rows", F.lit(0))).over(each))
    leads = cut(counted.where("least > 0").withColumn("_n", F.row_number().over(each.orderBy("rows", "term"))).where(F.col("_n") <= LEADS).drop("_n", "least", "rows"))
    led = index.spots(spark, leads).mapInArrow(_homes, "term string, doc_id long, unit int, symbol boolean")
    owners = led.join(leads, ["term", "symbol"]).groupBy("query_id", "symbol", "m", "doc_id", "unit").agg(F.count_distinct("term").alias("met")).where(F.col("met") == F.least("m", F.lit(LEADS))).drop("met")
    wanted = cut(owners.join(allowed.select("doc_id"), "doc_id", "left_semi").join(asked.drop("m"), ["query_id", "symbol"]))
    # places of most words of all documents are read, and few wanted: what is left out in
    # the task isn't shuffled, however many documents are wanted
    near = postings(index.spots(spark, asked, sieve(wanted.select("term", "doc_id").distinct())))
    near = near.join(wanted.select("term", "symbol", "doc_id", "unit").distinct(), ["term", "symbol", "doc_id", "unit"], "left_semi")
    near = cut(near.groupBy("term", "symbol", "doc_id", "unit", "field").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("places")).alias("places")))
    counts = cut(near.drop("places").join(wanted, ["term", "symbol", "doc_id", "unit"]))
    whole = counts.groupBy("query_id", "symbol", "doc_id", "unit", "m").agg(F.count_distinct("term").alias("met")).where("met = m").drop("met")
    bounds = _bounds(counts.join(whole, ["query_id", "symbol", "doc_id", "unit", "m"], "left_semi"))
    edge = Window.partitionBy("query_id").orderBy(F.desc("low"), "doc_id")
    kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    likely = bounds.withColumn("place", F.row_number().over(edge)).withColumn("edge", kth).where("edge is null or high >= edge - 1e-9").select("query_id", "doc_id")
    # a match whose terms stand in no single field has no bounds and scores 0
    bare = whole.select("query_id", "doc_id").distinct().join(bounds.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    left = cut(whole.join(likely.unionByName(bare), ["query_id", "doc_id"], "left_semi").join(asked.drop("m"), ["query_id", "symbol"]))
    places = near.select("term", "symbol", "doc_id", "unit", "field", "places").join(left, ["term", "symbol", "doc_id", "unit"])
    hits = places.groupBy("query_id", "symbol", "doc_id", "unit", "m").agg(F.collect_list(F.struct("field", "term", "places")).alias("hits"))
    ranked = hits.select("query_id", "symbol", "doc_id", "unit", "m", "hits").mapInArrow(_ranks, "query_id long, symbol boolean, doc_id long, unit int, ranks map<string,double>")
    return _scored(ranked, index.units(spark), k)


def _sum(ranks: Column, weights: dict[str, float]) -> Column:
    return sum((w * F.coalesce(ranks[f], F.lit(0.0)) for f, w in weights.items()), F.lit(0.0))


def _scored(ranked: DataFrame, units: DataFrame, k: int) -> DataFrame:
    of = lambda symbol: F.max_by("ranks", F.when(F.col("symbol") == symbol, 1))
    per = ranked.groupBy("query_id", "doc_id", "unit").agg(of(False).alias("plain"), of(True).alias("symbols"))
    own = F.col("unit") == OWN
    lone = lambda weight: F.when(F.col("plain").isNull(), weight * F.coalesce(F.col("symbols")["symbol"], F.lit(0.0))).otherwise(0.0)
    per = per.withColumn("score", F.when(own, _sum(F.col("plain"), DOCUMENT) + lone(SYMBOL["document"])).otherwise(_sum(F.col("plain"), UNIT) + lone(SYMBOL["unit"])))
    inner = per.where(~own & (F.col("score") > 0)).join(units, ["doc_id", "unit"])
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(F.round("score", 9)), "container", "unit")
    best = inner.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "doc_id", F.col("score").alias("unit_score"), F.col("unit_key"), F.col("plain").alias("unit_plain"), F.col("symbols").alias("unit_symbols"))
    docs = per.groupBy("query_id", "doc_id").agg(F.max_by("plain", F.when(own, 1)).alias("plain"), F.max_by("symbols", F.when(own, 1)).alias("symbols"), F.coalesce(F.max(F.when(own, F.col("score"))), F.lit(0.0)).alias("score"))
    met = docs.join(best, ["query_id", "doc_id"], "left")
    has = lambda ranks, f: F.coalesce(F.col(ranks)[f].isNotNull(), F.lit(False))
    shown = {**{f: has("plain", f) for f in ("external_id", "alias", "path", "title")}, "symbol": has("symbols", "symbol") & F.col("plain").isNull(), "heading": has("unit_plain", "heading"), "unit": has("unit_plain", "unit")}
    reason = F.when(has("unit_symbols", "symbol"), REASONS["symbol"]).otherwise(REASONS["body"])
    for f in reversed(shown):
        reason = F.when(shown[f], REASONS[f]).otherwise(reason)
    scored = met.select("query_id", "doc_id", F.round(F.col("score") + F.coalesce("unit_score", F.lit(0.0)), 6).alias("raw_score"), reason.alias("reason"), F.col("unit_key").alias("unit"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "doc_id"))
    return scored.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
