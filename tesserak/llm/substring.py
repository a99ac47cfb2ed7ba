"""Remove passages that a document with a smaller id holds too.

1. Each window of ``window`` words has an anchor: the run of ``run`` words inside
   it with the least hash.  Equal windows have equal anchors, so a count of the
   anchor's documents is never less than the window's.
2. A count-min sketch of two rows counts anchors.  Every scan task adds its own
   partial arrays, which are kept in blocks of cells; the blocks are merged by
   sums, and an anchor's estimate is the least of its cells.  The width follows
   the corpus, so the share of chance repeats stays the same at every size.
3. The second pass hashes only windows whose anchor is estimated to be repeated,
   and finds for each the smallest document exactly, by 128-bit hashes.

A row is known by its doc_id together with a hash of its text, so rows that share
an id but not a text keep their own spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Words, word_chunks
from .shared import cut, free_name


@dataclass(frozen=True)
class Settings:
    """``window`` words count as a passage; anchors are runs of ``run`` words.
    The sketch has two rows of ``cells`` cells per counted anchor, or up to twice
    as many, in blocks of ``block``; a task adds ``partial`` anchors at once."""

    window: int = 50
    run: int = 25
    cells: int = 4
    block: int = 1 << 20
    partial: int = 1 << 20


def _anchors(words: Words, hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor hash) of each window of some texts."""
    at, runs = words.windows(hashes, s.run)
    by_word = np.full(len(hashes) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    by_word[at] = runs
    starts, _ = words.windows(hashes, s.window)
    least, width = by_word[:-1], 1  # least run in [i, i + width)
    wanted = s.window - s.run + 1
    while width * 2 <= wanted:
        least = np.minimum(least, np.concatenate((least[width:], np.full(width, np.iinfo(np.uint64).max, np.uint64))))
        width *= 2
    return starts, np.minimum(least[starts], least[starts + wanted - width]) if len(starts) else least[:0]


_FIRST = "doc_id long, body long, n_words long, text_a long, text_b long, anchors array<long>"


def scan(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, body, n_words, text_a, text_b, anchors): the word count, a 128-bit hash
    of the word sequence, and the distinct anchors of each row (doc_id, body, text)."""

    def run(batches):
        for batch in batches:
            for at, to, words in word_chunks(batch.column("text"), False):
                n, hashes = to - at, words.hashes()
                whole = [words.wholes(words.hashes(i), i).view(np.int64) for i in (1, 2)]
                starts, anchors = _anchors(words, hashes, s)
                owner = words.text[starts]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1])
                owner, anchors = owner[new], anchors[new]
                ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(anchors.view(np.int64)))
                yield pa.record_batch([batch.column("doc_id").slice(at, n), batch.column("body").slice(at, n), pa.array(words.counts.astype(np.int64)), pa.array(whole[0]), pa.array(whole[1]), lists], ["doc_id", "body", "n_words", "text_a", "text_b", "anchors"])

    return docs.select("doc_id", "body", "text").mapInArrow(run, _FIRST)


def cells_of(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in both rows of a sketch of 2 ** ``bits`` cells a row:
    its low bits, and those of the anchor turned by half."""
    x = anchors.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return [(x & mask).view(np.int64), (((x >> np.uint64(32)) | (x << np.uint64(32))) & mask).view(np.int64)]


def _cell(row: int, bits: int) -> F.Column:
    """cells_of() as a column."""
    turned = F.col("anchor") if row == 0 else F.shiftrightunsigned("anchor", 32).bitwiseOR(F.shiftleft("anchor", 32))
    return turned.bitwiseAND(F.lit((1 << bits) - 1))


def partial_sketches(rows: DataFrame, bits: int, s: Settings) -> DataFrame:
    """(row, block, cells, counts): what a run of a task's rows adds to a block of the
    sketch, as 4-byte places of cells and 1-byte counts.

    Counts stop at 255, which is far beyond what is asked, so they never turn over.
    """

    def run(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("anchors")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            # an anchor that comes back in its document counts once
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            held.append(flat[new])
            n += len(held[-1])
            if n >= s.partial:
                yield from added(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from added(np.concatenate(held))

    def added(anchors):
        for row, cells in enumerate(cells_of(anchors, bits)):
            cells, counts = np.unique(cells, return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            block = cells // s.block
            firsts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            ends = [*firsts[1:].tolist(), len(block)]
            places = (cells % s.block).astype("<u4")
            yield pa.record_batch([pa.array([row] * len(firsts), pa.int32()), pa.array(block[firsts]), pa.array([places[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary())], ["row", "block", "cells", "counts"])

    return rows.select("anchors").mapInArrow(run, "row int, block long, cells binary, counts binary")


def merged_sketch(partial: DataFrame, s: Settings) -> DataFrame:
    """(row, cell, n): the cells that hold two or more, of the sum of all partial sketches.

    A block's cells are a fixed number, so a task's array is bounded; what comes in
    for a block is at most one entry a cell from each partial sketch.
    """

    def run(key, parts):
        total = np.zeros(s.block, dtype=np.uint16)
        for cells, counts in zip(parts.column("cells").to_pylist(), parts.column("counts").to_pylist(), strict=True):
            at = np.frombuffer(cells, dtype="<u4")
            total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), 255)
        full = np.flatnonzero(total > 1)
        n = len(full)
        return pa.table({"row": pa.array(np.full(n, key[0].as_py(), np.int32)), "cell": pa.array(full + key[1].as_py() * s.block), "n": pa.array(total[full].astype(np.int32))})

    return partial.groupBy("row", "block").applyInArrow(run, "row int, cell long, n int")


def repeated_anchors(rows: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, body, anchor) for anchors whose estimate, the least count of their
    cells, is two or more."""
    counted = rows.select(F.sum(F.size("anchors"))).first()[0] or 0
    bits = max(10, (s.cells * counted).bit_length())
    full = cut(merged_sketch(partial_sketches(rows, bits, s), s), "sketch")
    found = rows.select("doc_id", "body", F.explode("anchors").alias("anchor"))
    for row in (0, 1):
        cells = full.where(F.col("row") == row).select("cell")
        found = found.withColumn("cell", _cell(row, bits)).join(cells, "cell", "left_semi").select("doc_id", "body", "anchor")
    return found


def _windows(docs: DataFrame, s: Settings) -> DataFrame:
    """Windows of rows (doc_id, body, text, anchors) whose anchor is among ``anchors``.

    Of equal windows in a batch only the one of the smallest document goes on,
    with its hashes; the others are already known to repeat an earlier document
    and come out without hashes.  So a window that very many documents hold has a
    row per batch only.
    """

    def run(batches):
        for batch in batches:
            anchored = batch.column("anchors")
            for at, to, words in word_chunks(batch.column("text"), False):
                hashes = words.hashes()
                starts, anchors = _anchors(words, hashes, s)
                lists = anchored.slice(at, to - at)
                good = np.sort(lists.flatten().to_numpy().view(np.uint64))
                near = np.minimum(np.searchsorted(good, anchors), max(0, len(good) - 1))
                keep = good[near] == anchors if len(good) else np.zeros(len(anchors), bool)
                starts = starts[keep]
                if not len(starts):
                    continue
                own = []
                for seed in (1, 2):
                    where, got = words.windows(words.hashes(seed), s.window, seed)
                    own.append(got[np.searchsorted(where, starts)].view(np.int64))
                ids = batch.column("doc_id").slice(at, to - at).to_numpy()[words.text[starts]]
                body = batch.column("body").slice(at, to - at).to_numpy()[words.text[starts]]
                place = (starts - words.first[words.text[starts]]).astype(np.int32)
                order = np.lexsort((ids, own[1], own[0]))
                ids, body, place, a, b = ids[order], body[order], place[order], own[0][order], own[1][order]
                same = np.zeros(len(ids), dtype=bool)
                same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
                later = ids > ids[first]
                again = same & ~later  # the same window again in its first document
                for some, known in ((later, True), (~later & ~again, False), (again, False)):
                    n = int(some.sum())
                    if n:
                        hashed = [pa.nulls(n, pa.int64())] * 2 if known else [pa.array(a[some]), pa.array(b[some])]
                        yield pa.record_batch([pa.array(ids[some]), pa.array(body[some]), pa.array(place[some]), *hashed], ["doc_id", "body", "start", "win_a", "win_b"])

    return docs.select("doc_id", "body", "text", "anchors").mapInArrow(run, "doc_id long, body long, start int, win_a long, win_b long")


def spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, body, starts): where windows start that repeat an earlier document.

    Texts with equal word sequences form classes first: in all but the smallest
    document of a class every window repeats, so one representative is searched.
    """
    own = ["doc_id", "body"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_hash(), "text").where("doc_id is not null")
    rows = cut(scan(docs, s), "scan")
    long = rows.where(F.col("n_words") >= s.window)
    classes = cut(long.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "classes")
    copies = cut(long.select(*own, "text_a", "text_b").join(classes, ["text_a", "text_b"]).where("doc_id > first").select(*own).distinct(), "copies")
    heads = long.join(copies, own, "left_anti").select(*own, "anchors")
    marked = repeated_anchors(heads, s).groupBy(*own).agg(F.collect_set("anchor").alias("anchors"))
    found = cut(_windows(docs.join(marked, own), s), "windows")
    open_windows = found.where("win_a is not null")
    firsts = cut(open_windows.groupBy("win_a", "win_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    later = open_windows.join(firsts, ["win_a", "win_b"]).where("doc_id > first").select(*own, "start")
    starts = later.unionByName(found.where("win_a is null").select(*own, "start")).groupBy(*own).agg(F.collect_set("start").alias("starts"))
    whole = copies.select(*own, F.array(F.lit(-1)).alias("starts"))
    return cut(starts.unionByName(whole), "spans")


def body_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")


def _kept(n: int, starts: list | None, window: int) -> np.ndarray:
    """Which of n words stay; a start of -1 stands for all windows."""
    if not starts:
        return np.ones(n, dtype=bool)
    if -1 in starts:
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.asarray(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) == 0


def _with_spans(docs: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each row, and the name of their column."""
    key, body, mine, name = (free_name(docs, f"span_{x}") for x in ("doc", "body", "mine", "starts"))
    found = spans(docs, s).select(F.col("doc_id").alias(key), F.col("body").alias(body), F.col("starts").alias(name))
    rows = docs.withColumn(mine, body_hash())
    same = (rows.doc_id.cast("long") == found[key]) & (rows[mine] == found[body])
    return rows.join(found, same, "left").drop(key, body, mine), name


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row (doc_id, text).

    A word goes if a window over it also starts in a document with a smaller id;
    windows are judged on the input.  Rows with one id are one document to that
    rule, so none of them takes words from another; each keeps what its own text
    keeps.  A null text has no words; a text of fewer words than a window, and a row
    with a null id, keep all.  Columns of other names are dropped; no rows: none.
    """
    import hashlib

    rows, name = _with_spans(docs.select("doc_id", "text"), s)

    def run(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                words = (text or "").encode().split()
                keep = _kept(len(words), starts if len(words) >= s.window else None, s.window)
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if starts else words
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            n, gone, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))


def _cut_text(text: str, starts: list, window: int) -> str:
    """``text`` without its repeated words and the white space before them."""
    import re

    found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    if len(found) < window:
        return text
    out, at = [], 0
    for (_, end), keep in zip(found, _kept(len(found), starts, window).tolist(), strict=True):
        if keep:
            out.append(text[at:end])
        at = end
    return "".join(out) + (text[at:] if out else "")


def remove_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; all columns and rows stay.

    Rules are those of digests(), repeated rows and null ids included; a null text
    stays null.  White space between kept words stays as it is.
    """
    rows, name = _with_spans(docs, s)
    schema = docs.schema

    def run(batches):
        for b in batches:
            starts, texts = b.column(name).to_pylist(), b.column("text").to_pylist()
            texts = [_cut_text(t, x, s.window) if x and t else t for t, x in zip(texts, starts, strict=True)]
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in schema.names], schema.names)

    return rows.select(*docs.columns, name).mapInArrow(run, schema)


def brute_force(texts: dict[int, str | None], window: int) -> dict[int, list[bool]]:
    """Which words of each text stay, by comparing all windows; for small tests."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at : at + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < i:
                keep[at : at + window] = [False] * window
        out[i] = keep
    return out

