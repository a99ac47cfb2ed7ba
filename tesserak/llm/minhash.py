"""Near-duplicate documents by fast similarity sketches, banding and exact checks.

The sketch is filled in rounds.  Round i < t hashes every shingle to a bin and a
value i + fraction; round t + j sends every shingle to bin j.  A bin keeps its
least value and rounds stop once every bin has one, so all t coordinates are
always filled and their agreement concentrates around the similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, mix, text_buffers, word_chunks
from .shared import components, cut, in_bounded_groups, part_pairs, small_batches


@dataclass(frozen=True)
class Settings:
    """``words`` in a shingle; ``share``: least similarity of a link, in percent;
    ``bands`` of ``rows`` coordinates each.  With 32 bands of 4, a pair at 0.80
    shares no band with a chance of 5e-8.  ``agree``: coordinates that a pair
    needs before its full sets are compared; 0.6 of them is 5.7 standard
    deviations under what a pair at 0.80 has.  ``pairs``: classes of a band up to
    which its pairs are listed; ``group``: classes that one task compares at once
    beyond that."""

    words: int = 5
    share: int = 80
    bands: int = 32
    rows: int = 4
    agree: float = 0.6
    pairs: int = 48
    group: int = 512
    lower: bool = True


_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketches(text: np.ndarray, hashed: np.ndarray, n: int, t: int) -> np.ndarray:
    """t coordinates for each of n sets, given as (set, element hash) pairs.

    An empty set has the greatest value in every coordinate.
    """
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    empty = out[0] if n else 0
    for i in range(2 * t):
        if not len(text):
            break
        got = mix(hashed ^ _SEEDS[i])
        bins = (got % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, text * t + bins, (np.uint64(i) << np.uint64(50)) | (got >> np.uint64(14)))
        open_sets = (out.reshape(n, t) == empty).any(axis=1)
        going = open_sets[text]
        if not going.all():
            text, hashed = text[going], hashed[going]
    return out.reshape(n, t)


_SKETCH = "doc_id long, same long, n_shingles long, set_a long, set_b long, sketch binary"


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, same, n_shingles, set_a, set_b, sketch) of rows (doc_id, same, text).

    (set_a, set_b) is a 128-bit hash of the shingle set; ``sketch`` holds one byte
    pair per coordinate; ``same`` tells the texts of one doc_id apart.
    """
    t = s.bands * s.rows

    def run(batches):
        for batch in batches:
            for at, to, words in word_chunks(batch.column("text"), s.lower):
                text, hashed = words.shingle_sets(s.words)
                n = to - at
                size = np.bincount(text, minlength=n)
                ends = np.concatenate(([0], np.cumsum(size)))
                digest = []
                for seed in (3, 4):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashed ^ _SEEDS[-seed]))))
                    digest.append(mix(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                coordinates = mix(sketches(text, hashed, n, t)).astype(np.uint16)
                yield pa.record_batch([batch.column("doc_id").slice(at, n), batch.column("same").slice(at, n), pa.array(size.astype(np.int64)), *map(pa.array, digest), pa.array([x.tobytes() for x in coordinates], pa.binary())], ["doc_id", "same", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.mapInArrow(run, _SKETCH)


def _bands(rows: DataFrame, s: Settings) -> DataFrame:
    """One row (band, node) per band of each sketch."""
    width = 2 * s.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width))))
    return rows.select(F.explode(keys).alias("band"), "node")


def _texts(nodes: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): a text of each node, written once for the joins that need it.

    The nodes grow with the corpus, so both sides are shuffled at every size; a row
    that repeats is taken once.
    """
    wanted = heads.join(nodes, "node").select("doc_id", "same", "node")
    return cut(docs.join(wanted.hint("merge"), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]).select("node", "text"), "texts")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def likely(pairs: DataFrame, heads: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the wanted similarity."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(heads.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
            keep = pa.array((x == y).sum(axis=1) >= s.agree * s.bands * s.rows)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    sized = both.where(100 * F.least("n_a", "n_b") >= s.share * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keep = _similar(part.column("text_a"), part.column("text_b"), s)
                yield pa.record_batch([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _similar(left: pa.Array, right: pa.Array, s: Settings) -> pa.Array:
    keep = []
    sets = []
    for column in (left, right):
        got = []
        for at, to, words in word_chunks(column, s.lower):
            text, hashed = words.shingle_sets(s.words)
            ends = np.searchsorted(text, np.arange(to - at + 1))
            got += [hashed[ends[i] : ends[i + 1]] for i in range(to - at)]
        sets.append(got)
    for a, b in zip(*sets, strict=True):
        both = len(np.intersect1d(a, b, assume_unique=True))
        keep.append(both > 0 and 100 * both >= s.share * (len(a) + len(b) - both))
    return pa.array(keep, pa.bool_())


def _sets(texts: DataFrame, s: Settings) -> DataFrame:
    """(node, shingles): the full set of each text, as 64-bit hashes in order."""

    def run(batches):
        for batch in batches:
            for at, to, words in word_chunks(batch.column("text"), s.lower):
                text, hashed = words.shingle_sets(s.words)
                ends = np.searchsorted(text, np.arange(to - at + 1))
                yield pa.record_batch([batch.column("node").slice(at, to - at), pa.array([hashed[ends[i] : ends[i + 1]].tobytes() for i in range(to - at)], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


#: Elements of the sets of a group that are compared at once.
BLOCK = 1 << 16


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many elements sets ``rows`` and ``columns`` share, each in ascending order.

    The hash space is gone through in ranges of about BLOCK elements, each a small
    dense product, so memory doesn't grow with the sets.
    """
    blocks = max(1, -(-sum(map(len, sets)) // BLOCK))
    bounds = np.array([(i << 64) // blocks for i in range(1, blocks)], dtype=np.uint64)
    ends = np.array([[0, *np.searchsorted(x, bounds), len(x)] for x in sets], dtype=np.int64)
    both = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for i in range(blocks):
        elements = np.concatenate([x[e[i] : e[i + 1]] for x, e in zip(sets, ends, strict=True)])
        if not len(elements):
            continue
        row = np.repeat(np.arange(len(sets)), ends[:, i + 1] - ends[:, i])
        _, column, times = np.unique(elements, return_inverse=True, return_counts=True)
        many = times[column] > 1
        has = np.zeros((len(sets), int((times > 1).sum())), dtype=np.float32)
        has[row[many], (np.cumsum(times > 1) - 1)[column[many]]] = 1
        both += has[rows] @ has[columns].T
    return both


def _group_links(s: Settings):
    """Links between components of one group, by full sets; a forest of them is enough."""

    def run(key, table):
        left, right = key[1].as_py(), key[2].as_py()
        ids, part, met = (table.column(c).to_numpy() for c in ("node", "part", "component"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        root = {int(c): int(c) for c in met}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        columns = np.flatnonzero(part == right)
        rows = np.flatnonzero(part == left)
        shared = shared_counts(sets, rows, columns)
        for at in range(0, len(rows), 128):
            some, both = rows[at : at + 128], shared[at : at + 128]
            near = (100 * both >= s.share * (size[some, None] + size[columns] - both)) & (both > 0) & (met[some, None] != met[columns])
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = some[i], columns[j]
                x, y = find(int(met[a])), find(int(met[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _group_pairs(s: Settings):
    """Pairs of one group that aren't known to be connected and may be similar."""
    need = s.agree * s.bands * s.rows

    def run(key, table):
        ids = table.column("node").to_numpy()
        size, met = table.column("n_shingles").to_numpy(), table.column("component").to_numpy()
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
        a_out, b_out = [], []
        for i in range(len(ids)):
            j = np.flatnonzero((met != met[i]) & (ids > ids[i]))
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            j = j[100 * low >= s.share * high]
            j = j[(rows[j] == rows[i]).sum(axis=1) >= need]
            a_out.append(np.minimum(ids[i], ids[j]))
            b_out.append(np.maximum(ids[i], ids[j]))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a_out or empty), "b": np.concatenate(b_out or empty)})

    return run


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row (doc_id, text).

    Links documents whose shingle sets have ``share`` percent of their union in
    common.  ``component_id`` is the smallest doc_id that links reach; ``kept``
    marks it.  Texts with equal sets form one class at once; then

    1. in each band, every class is checked against the band's first one, which
       costs a row per class and not a pair;
    2. a band of up to ``pairs`` classes that still holds several components gives
       the pairs of them whose sketches agree enough, for a check on full sets;
    3. larger ones that share classes are joined, each class is taken once, dealt
       to parts of bounded size, and every two parts are compared on full sets in
       one task, which returns a forest of links and no pairs.

    A text that is null or has no words is empty: 0 shingles and its own
    component.  Rows with the same doc_id are one document to links, with all their
    texts; each row is returned.  A null doc_id has null component and is kept.  No rows: none.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, s)


def _near_duplicates(docs: DataFrame, s: Settings) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    rows = cut(sketch(docs, s), "sketches")
    real = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "classes")
    again = real.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"])
    copies = cut(again.where("doc_id > first").select("first", "doc_id", "set_a", "set_b").distinct(), "copies")
    # a node is one class of equal sets, whatever else its ids stand with
    heads = real.join(copies.drop("first"), ["doc_id", "set_a", "set_b"], "left_anti").dropDuplicates(["doc_id", "set_a", "set_b"])
    heads = cut(heads.select(F.monotonically_increasing_id().alias("node"), "doc_id", "same", "n_shingles", "sketch"), "heads")

    bands = _bands(heads, s)
    shared = cut(bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("held")).where("held > 1"), "bands")
    members = cut(bands.join(shared, "band"), "members")
    stars = cut(members.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    near = cut(likely(stars, heads, s), "near")
    links = cut(verified(near, _texts(_ends(near), heads, docs), s), "links")
    labels = components(links).withColumnRenamed("node", "named")

    named = members.where("held > 2").join(labels, members.node == labels.named, "left").select("band", "node", "held", F.coalesce("component", "node").alias("component"))
    split = cut(named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"), "split")
    left = cut(named.join(split, "band"), "open")
    listed = left.where(F.col("held") <= s.pairs).join(heads, "node").groupBy("band").applyInArrow(_group_pairs(s), "a long, b long")
    more = cut(listed.distinct().join(stars, ["a", "b"], "left_anti"), "pairs")

    large = left.where(F.col("held") > s.pairs)
    ties = large.groupBy("node").agg(F.min("band").alias("a"))
    one = components(cut(large.join(ties, "node").select("a", F.col("band").alias("b")).distinct(), "ties")).withColumnsRenamed({"node": "tied", "component": "group"})
    large = large.join(one, large.band == one.tied, "left").select(F.coalesce("group", "band").alias("band"), "node", "component").distinct()
    large = part_pairs(in_bounded_groups(cut(large, "large"), "band", "node", s.group))
    texts = _texts(_ends(more).union(left.where(F.col("held") > s.pairs).select("node")).distinct(), heads, docs)
    sets = cut(_sets(texts.join(large.select("node").distinct(), "node", "left_semi"), s), "sets")
    dense = large.join(sets, "node").groupBy("band", "left", "right").applyInArrow(_group_links(s), "a long, b long")
    found = links.unionByName(cut(dense, "dense")).unionByName(verified(more, texts, s))
    of = lambda side: heads.select(F.col("node").alias(side), F.col("doc_id").alias("doc_" + side))
    found = found.join(of("a"), "a").join(of("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    labels = components(found.unionByName(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
    out = rows.select("doc_id", "n_shingles").join(labels, rows.doc_id == labels.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def shingle_set(text: str | None, s: Settings) -> set:
    """The shingle set of one text, for checks."""
    data, offsets = text_buffers(pa.array([text], pa.string()))
    return set(Words(data, offsets, s.lower).shingle_sets(s.words)[1].tolist())
