"""Byte-level BPE: encode through a table of distinct words, decode through pieces.

Words are cut so that merges never cross them: at each single space or line feed
between two characters that are not white space.  Texts with other white space
are cut by the vocabulary's own split pattern.

Decoding joins ids with the id-to-piece table, which the vocabulary bounds, and
puts the pieces back by position.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Fixed values of the format: the split pattern and the printable stand-ins of bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Words of so many characters are split before they are merged, and aren't remembered.
LONG = 10_000
#: Characters of text that one task of a shuffle stands for, about.
TASK_CHARS = 16 << 20


@lru_cache(1)
def byte_of_stand_in() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(merge pieces, special strings) with ids, from a tokenizer's JSON file.

    The file must number merged pieces in merge order, as ranked BPE does.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    back = byte_of_stand_in()
    ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m.replace(" ", "")] for m in merged]
    if order != sorted(order):
        raise ValueError(f"{path}: merged pieces aren't numbered in merge order")
    return ranks, special


@lru_cache(2)
def merger(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=vocabulary(path)[0], special_tokens={})


class _Irregular(Exception):
    """White space that a plain cut can't handle."""


class Known(dict):
    """word -> what ``make`` gives for it; forgets all beyond ``most`` words."""

    def __init__(self, make, before: str = "", most: int = 400_000):
        self.make, self.before, self.most = make, before, most

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        if len(self) >= self.most:
            self.clear()
        out = self.make(self.before + word)
        if len(word) < LONG:
            self[word] = out
        return out


class Splitter:
    """``parts(text)``: what ``make`` gives for each word of ``text``, in order."""

    def __init__(self, path: str, make, most: int = 400_000):
        self.special = vocabulary(path)[1]
        self.make, self.most = make, most
        self.apart = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.first, self.later = Known(make, "", most), Known(make, " ", most)
        self.rare = regex.compile(SPLIT)

    def has_special(self, text: str) -> bool:
        return self.apart is not None and "<" in text and self.apart.search(text) is not None

    def parts(self, text: str) -> list:
        if not self.has_special(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.make(m[0]))
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list:
        if not text:
            return []
        out, later = [], self.later
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                if out:
                    out.append(self.make("\n"))
                out.append(self.first[words[0]])
                if len(words) > 1:
                    out += [later[w] for w in words[1:]]
            return out
        except _Irregular:
            return [self.make(w) for w in self.rare.findall(text)]


def word_encoder(path: str):
    """word -> its ids as little-endian unsigned 32-bit numbers.

    A long word is split here and its pieces merged one by one, as the merging
    library's own matcher gives up on long runs of white space.
    """
    merge, special, cut = merger(path), vocabulary(path)[1], regex.compile(SPLIT)

    def one(word: str) -> bytes:
        if word in special:
            return np.asarray([special[word]], dtype="<u4").tobytes()
        if len(word) < LONG:
            return np.asarray(merge.encode_ordinary(word), dtype="<u4").tobytes()
        return b"".join(np.asarray(merge._encode_single_piece(m[0]), dtype="<u4").tobytes() for m in cut.finditer(word))

    return one


def text_encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit numbers."""
    known: dict[str, bytes] = {}
    one = word_encoder(path)

    def make(word: str) -> bytes:
        if len(word) > 2:
            return one(word)
        if word not in known:
            known[word] = one(word)
        return known[word]

    parts = Splitter(path, make).parts
    return lambda text: b"".join(parts(text))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table (id int, piece binary), special strings included.

    Its size is that of the vocabulary file, whatever the corpus.
    """
    ranks, special = vocabulary(path)
    rows = [(i, bytearray(p)) for p, i in ranks.items()] + [(i, bytearray(s.encode())) for s, i in special.items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def distinct_words(texts: Iterable[str | None], path: str) -> set[str]:
    """The words that a ``Splitter`` gives for ``texts``, found without their order."""
    whole = Splitter(path, str)
    first, later, other = set(), set(), set()
    for text in filter(None, texts):
        heads, tails = set(), set()
        lines = text.split("\n")
        for line in lines:
            words = line.split(" ")
            heads.add(words[0])
            tails.update(words[1:])
        new = (heads - first) | (tails - later)
        if whole.has_special(text) or any(not w or w[0].isspace() or w[-1].isspace() for w in new):
            other.update(whole.parts(text))
            continue
        first |= heads
        later |= tails
        if len(lines) > 1:
            other.add("\n")
    return first.union(other, (" " + w for w in later))


def _numbered(words: Iterable[str], buckets: int) -> tuple[list[str], np.ndarray]:
    """Words by bucket (a hash) and then by text, and the first place of each bucket."""
    words = sorted(words)
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(bucket, kind="stable")
    return [words[i] for i in order.tolist()], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _places(texts: list[str | None], path: str, buckets: int) -> tuple[list[np.ndarray], int]:
    """The numbers of each text's words, in order, and how many distinct words there are."""
    table: dict[str, int] = {}
    parts = Splitter(path, lambda w: table.setdefault(w, len(table)), 1 << 40).parts
    found = [np.asarray(parts(text or ""), dtype=np.int64) for text in texts]
    used = np.zeros(len(table), dtype=bool)  # a text that turns out irregular leaves words in the table
    for x in found:
        used[x] = True
    ordered, _ = _numbered((w for w, i in table.items() if used[i]), buckets)
    rank = np.zeros(len(table), dtype="<u4")
    rank[[table[w] for w in ordered]] = np.arange(len(ordered), dtype="<u4")
    return [rank[x] for x in found], len(ordered)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, list]]:
    """(block, doc ids, texts): runs of rows of one task with about ``most`` characters."""
    from pyspark import TaskContext

    part, ids, texts, size, n = TaskContext.get().partitionId(), [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 50
                if size >= most:
                    yield (part << 32) | n, ids, texts
                    ids, texts, size, n = [], [], 0, n + 1
    if ids:
        yield (part << 32) | n, ids, texts


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 3)


def _spread(data: bytes, kind: str) -> np.ndarray:
    raw, size = zstandard.decompress(data), np.dtype(kind).itemsize
    return np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T.copy().reshape(-1).view(kind)


def split_words(docs: DataFrame, path: str, buckets: int, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """Split texts to words, block by block, as two tables.

    (bucket, block, first, sizes, words): a block's distinct words of a bucket, of
    which the first has the place ``first``; and (block, doc_id, n_words, places):
    the places, in order, of a document's words among the block's.  Even a word
    that every document holds stands only once in a block.
    """

    def words(batches):
        for block, _, texts in _blocks(batches, block_chars):
            words, firsts = _numbered(distinct_words(texts, path), buckets)
            rows = [(b, firsts[b], [w.encode() for w in words[firsts[b] : firsts[b + 1]]]) for b in range(buckets) if firsts[b] < firsts[b + 1]]
            for at in range(0, len(rows), 100):
                some = rows[at : at + 100]
                sizes = [_squeeze(np.array([len(w) for w in r[2]], dtype="<u4")) for r in some]
                packed = [zstandard.compress(b"".join(r[2]), 3) for r in some]
                yield pa.record_batch([pa.array([r[0] for r in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array(sizes, pa.binary()), pa.array(packed, pa.binary())], ["bucket", "block", "first", "sizes", "words"])

    def places(batches):
        for block, ids, texts in _blocks(batches, block_chars):
            found, n_words = _places(texts, path, buckets)
            for at in range(0, len(ids), 500):
                some = ids[at : at + 500]
                n = len(some)
                yield pa.record_batch([pa.array([block] * n, pa.int64()), pa.array(some, pa.int64()), pa.array([n_words] * n, pa.int64()), pa.array([_squeeze(x) for x in found[at : at + 500]], pa.binary())], ["block", "doc_id", "n_words", "places"])

    return docs.mapInArrow(words, "bucket int, block long, first long, sizes binary, words binary"), docs.mapInArrow(places, "block long, doc_id long, n_words long, places binary")


def encode_distinct(words: DataFrame, path: str, tasks: int, most: int = 500_000) -> DataFrame:
    """(block, first, sizes, ids, id) of rows (bucket, block, first, sizes, words).

    All occurrences of a word are in one bucket, so each distinct word is encoded
    once (again only if a task meets more than ``most`` of them).  Before a row stand
    rows of only an ``id``, one for each id that the task meets there for the first
    time: their number is bounded by the vocabulary.
    """

    def run(batches):
        one, known, met = word_encoder(path), {}, np.zeros(0, dtype="<u4")
        for batch in batches:
            for block, first, sizes, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "sizes", "words")), strict=True):
                ends = np.cumsum(_spread(sizes, "<u4")).tolist()
                text, at, got = zstandard.decompress(texts), 0, []
                for end in ends:
                    word, at = text[at:end], end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= most:
                            known.clear()
                        ids = one(word.decode())
                        if len(word) < LONG:
                            known[word] = ids
                    got.append(ids)
                ids = np.frombuffer(b"".join(got), dtype="<u4")
                new = np.setdiff1d(ids, met)
                met = np.union1d(met, new)
                none = [None] * len(new)
                sizes = _squeeze(np.array([len(x) // 4 for x in got], dtype="<u4"))
                columns = ([*none, block], [*none, first], [*none, sizes], [*none, _squeeze(ids)], [*new.tolist(), None])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["block", "first", "sizes", "ids", "id"])

    return words.repartition(tasks, "bucket").mapInArrow(run, "block long, first long, sizes binary, ids binary, id int")


def with_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(block, first, sizes, ids) of rows of encode_distinct(): its whole rows, and for
    each a row without ``first`` that holds its distinct ids and their pieces.

    The pieces come from a join of a task's ids with the id-to-piece table, which the
    vocabulary bounds and which goes to every task; the join keeps the rows' order.
    """
    joined = encoded.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left")

    def run(batches):
        known: dict[int, bytes] = {}
        for batch in batches:
            for i, (number, piece) in enumerate(zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
                if number is not None:
                    known[number] = piece
                    continue
                row = batch.slice(i, 1).select(["block", "first", "sizes", "ids"])
                yield row
                used = np.unique(_spread(row.column("ids")[0].as_py(), "<u4"))
                mine = [known[x] for x in used.tolist()]
                sizes = np.concatenate((used, np.array([len(x) for x in mine], dtype="<u4")))
                yield pa.record_batch([row.column("block"), pa.nulls(1, pa.int64()), pa.array([_squeeze(sizes)], pa.binary()), pa.array([zstandard.compress(b"".join(mine), 3)], pa.binary())], ["block", "first", "sizes", "ids"])

    return joined.select("block", "first", "sizes", "ids", "id", "piece").mapInArrow(run, "block long, first long, sizes binary, ids binary")


def _join_back(key, table, docs):
    """A block's words' ids, in the order of places, put back for each document, and
    the pieces of those ids, joined."""
    is_word = table.column("first").is_valid()
    words, known = table.filter(is_word), table.filter(pa.compute.invert(is_word))
    piece: dict[int, bytes] = {}
    for sizes, packed in zip(known.column("sizes").to_pylist(), known.column("ids").to_pylist(), strict=True):
        ids, n = _spread(sizes, "<u4").reshape(2, -1)
        data, at = zstandard.decompress(packed), 0
        for i, end in zip(ids.tolist(), np.cumsum(n).tolist(), strict=True):
            piece[i], at = data[at:end], end
    order = np.argsort(words.column("first").to_numpy())
    sizes = [_spread(x, "<u4") for x in words.column("sizes").to_pylist()]
    ids = [_spread(x, "<u4") for x in words.column("ids").to_pylist()]
    sizes = np.concatenate([sizes[i] for i in order] + [np.zeros(0, "<u4")]).astype(np.int64)
    flat = np.concatenate([ids[i] for i in order] + [np.zeros(0, "<u4")])
    starts = np.cumsum(sizes) - sizes
    if set(docs.column("n_words").to_pylist()) - {len(sizes)}:
        raise RuntimeError(f"block {key[0].as_py()} was read differently: the input isn't a stable table")
    keys, lists, texts = docs.column("doc_id"), [], []
    for packed in docs.column("places").to_pylist():
        at = _spread(packed, "<u4")
        n = sizes[at]
        ends = np.cumsum(n)
        take = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        lists.append(flat[take].astype(np.int32))
        texts.append(b"".join(map(piece.__getitem__, lists[-1].tolist())).decode("utf-8", "replace"))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
    return pa.table({"doc_id": keys, "ids": ids, "decoded": pa.array(texts, pa.string())})


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", stable: bool = False, block_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of each row: its ids and what they decode to.

    Ids are those that the tokenizer at ``path`` gives whole texts, without special
    tokens being added; strings of special tokens that a text holds get their ids.
    Decoding joins a block's distinct ids with the id-to-piece table and puts the
    pieces back by position; bytes that aren't UTF-8 become U+FFFD.  A null or
    empty text has no ids and decodes to an empty text; repeated rows and null keys
    stay as they are; other columns are dropped; no rows: none.  The rows are read
    again and again, so they are written first unless they are ``stable``: the
    plain scan of a table.  The number of tasks follows the number of characters.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not stable:
        rows = cut(rows, "rows")
    chars = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(10_000, 1 + chars // TASK_CHARS)
    words, places = split_words(rows, path, tasks, block_chars)
    table = with_pieces(encode_distinct(words, path, tasks), path).repartition(tasks, "block")
    return table.groupBy("block").cogroup(places.repartition(tasks, "block").groupBy("block")).applyInArrow(_join_back, "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, ids array<int>) of each row: those of round_trip(), whose options it takes."""
    return round_trip(docs, path, **options).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>) from anywhere: their pieces, joined.

    Every id is joined with the id-to-piece table, which goes to every task, so no
    document moves and the ids of one stay together, in order.  Bytes that aren't
    UTF-8 become U+FFFD; ids that the vocabulary lacks give nothing; no or null ids
    give an empty text.  Repeated rows stay as they are.
    """
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "ids")
    ids = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = ids.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left").select("row", "doc_id", "pos", "piece")

    def run(batches):
        row, place, keys, parts = -1, -1, [], []
        for batch in batches:
            for here, doc, pos, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != row:
                    if len(keys) == 200:
                        yield texts(keys, parts)
                        keys, parts = [], []
                    keys.append(doc)
                    parts.append([])
                    row, place = here, -1
                if pos is not None:
                    if pos != place + 1:
                        raise RuntimeError("the ids of a document came out of order")
                    place = pos
                    parts[-1].append(piece or b"")
        if keys:
            yield texts(keys, parts)

    def texts(keys, parts):
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array([b"".join(p).decode("utf-8", "replace") for p in parts], pa.string())], ["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id long, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows of round_trip()."""
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rank_file_pieces(path: str) -> dict[bytes, int]:
    """Pieces of a file of base64 ranks, for checks against the JSON file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
