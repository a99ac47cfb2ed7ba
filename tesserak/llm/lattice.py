"""Near-duplicate embeddings by E8 lattice hashing.

1. Each table projects unit vectors to blocks of eight dimensions at random and
   decodes each block to the nearest point of the E8 lattice.  A vector stands in
   the cell of its own points and in those of the neighbouring points that it lies
   nearest to.  The number of blocks follows the largest label, so a cell of
   evenly spread vectors stays small at every size; the number of tables follows
   from the chance that a pair at the wanted cosine shares a cell of one table.
2. A cell that holds too many is split by a further block, in several tables,
   unless most of it stays together: then its vectors really are close, and they
   are compared in parts of bounded size.  Cells are never joined.
3. The cosine of every pair that shares a cell is verified in double precision.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .shared import components, cut, in_bounded_groups, part_pairs


@dataclass(frozen=True)
class Settings:
    """``least`` cosine of a link; ``recall``: chance that a pair just there shares a
    cell; ``options``: a block's own point and neighbouring ones; ``scale``: lattice
    units per unit of a projected coordinate.  Of 128 random signs a pair may differ
    in ``differ`` (a pair at 0.93 differs in 15.4, with a deviation of 3.7) to be
    verified.  Cells of more than ``cell`` vectors are split up to ``levels`` times,
    or compared in parts of ``group``."""

    least: float = 0.93
    recall: float = 0.99
    options: int = 3
    scale: float = 0.6
    differ: int = 38
    cell: int = 96
    levels: int = 3
    group: int = 512
    seed: int = 17


#: The share of evenly spread vectors in a block's fullest cell, neighbours included.
FULLEST = 0.04


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight coordinates."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def _key(points: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash of E8 points and of the key ``before`` them."""
    key = mix(before.astype(np.int64).view(np.uint64) + np.uint64(1))
    for c in np.rint(2 * points).astype(np.int64).view(np.uint64).T:
        key = mix(key ^ mix(c))
    return key.view(np.int64)


def block_keys(y: np.ndarray, before: list[np.ndarray], options: int) -> list[np.ndarray]:
    """Each key ``before`` with a block's own point and its nearest neighbours."""
    home = decode(y)
    toward = (y - home) @ shortest().T
    near = np.argsort(-toward, axis=1)[:, : options - 1].T
    points = [home, *(home + shortest()[k] for k in near)]
    return [_key(p, x) for x in before for p in points]


def layout(largest: int, s: Settings) -> tuple[int, int]:
    """(blocks of a cell, tables) for labels of up to ``largest`` vectors.

    The chance that a pair at the least cosine shares a cell of one table is taken
    from 2,000 drawn pairs; it doesn't depend on the data or their dimension.
    """
    blocks = 1
    while largest * FULLEST**blocks > s.cell and blocks < 8:
        blocks += 1
    rng = np.random.default_rng([s.seed, blocks])
    x, z = rng.normal(size=(2, 2000, 8 * blocks)) * s.scale
    both = []
    for v in (x, s.least * x + np.sqrt(max(0.0, 1 - s.least**2)) * z):
        keys = [np.zeros(2000, dtype=np.int64)]
        for b in range(blocks):
            keys = block_keys(v[:, 8 * b : 8 * b + 8], keys, s.options)
        both.append(np.stack(keys, axis=1))
    met = min(0.999, float((both[0][:, :, None] == both[1][:, None]).any(axis=(1, 2)).mean()))
    return blocks, max(1, int(np.ceil(np.log(1 - s.recall) / np.log(1 - max(met, 1e-3)))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_size(batch: pa.RecordBatch):
    """(rows, unit vectors) of each length of vectors in a batch."""
    sizes = batch.column("embedding").value_lengths().to_numpy()
    for size in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield int(size), part, _unit(_matrix(part.column("embedding")))


def _cells(vectors: DataFrame, blocks: int, tables: int, s: Settings) -> DataFrame:
    """(cell, vec, low, high): each vector's cells, with 128 signs of projections."""

    def run(batches):
        for batch in batches:
            for size, part, x in _by_size(batch):
                label, ids = part.column("label").to_numpy(), part.column("vec").to_numpy()
                rng = np.random.default_rng([s.seed, size])
                signs = np.packbits(x @ rng.normal(size=(size, 128)) > 0, axis=1).view(np.int64)
                keys = []
                for table in range(tables):
                    mine = [_key(np.full((len(x), 1), table + 1000 * size), label)]
                    for _ in range(blocks):
                        mine = block_keys(x @ rng.normal(size=(size, 8)) * s.scale, mine, s.options)
                    keys += mine
                n = len(keys)
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, n)), pa.array(np.tile(signs[:, 0], n)), pa.array(np.tile(signs[:, 1], n))], ["cell", "vec", "low", "high"])

    return vectors.select("vec", "label", "embedding").mapInArrow(run, "cell long, vec long, low long, high long")


def _split(cells: DataFrame, vectors: DataFrame, level: int, s: Settings) -> DataFrame:
    """(cell, sub, vec, low, high): rows (cell, vec, low, high) in cells of one more
    block, in as many tables as keep the recall."""
    tables = layout(1, s)[1]

    def run(batches):
        for batch in batches:
            for size, part, x in _by_size(batch):
                cell, rng, keys = part.column("cell").to_numpy(), np.random.default_rng([s.seed, size, level]), []
                for table in range(tables):
                    keys += block_keys(x @ rng.normal(size=(size, 8)) * s.scale, [_key(np.full((len(x), 1), table), cell)], s.options)
                again = pa.array(np.tile(np.arange(len(x)), len(keys)))
                columns = [part.column(c).take(again) for c in ("cell", "vec", "low", "high")]
                yield pa.record_batch([columns[0], pa.array(np.concatenate(keys)), *columns[1:]], ["cell", "sub", "vec", "low", "high"])

    rows = cells.join(vectors.select("vec", "embedding"), "vec").select("cell", "vec", "low", "high", "embedding")
    return rows.mapInArrow(run, "cell long, sub long, vec long, low long, high long")


def sorted_cells(vectors: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(small, dense): rows (cell, vec, low, high) of cells with at most ``cell``
    vectors, and rows (cell, vec) of those that stay larger."""
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    open_ = cut(_cells(vectors, *layout(largest, s), s).distinct(), "cells")
    small, dense = [], []
    for level in range(s.levels + 1):
        large = cut(open_.groupBy("cell").agg(F.count("*").alias("held")).where(F.col("held") > s.cell), "large")
        small.append(open_.join(large, "cell", "left_anti"))
        over = open_.join(large, "cell")
        if large.isEmpty():
            break
        if level == s.levels:
            dense.append(over.select("cell", "vec"))
            break
        parts = cut(_split(over.drop("held"), vectors, level, s).distinct(), "split")
        most = parts.groupBy("cell", "sub").count().groupBy("cell").agg(F.max("count").alias("most"))
        close = cut(most.join(large, "cell").where(2 * F.col("most") > F.col("held")).select("cell"), "close")
        dense.append(over.join(close, "cell", "left_semi").select("cell", "vec"))
        open_ = cut(parts.join(close, "cell", "left_anti").select(F.col("sub").alias("cell"), "vec", "low", "high").distinct(), "cells")
    none = open_.where("false").select("cell", "vec")
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, dense, none)


def _near_pairs(s: Settings):
    """Pairs of equal cells, from rows sorted by cell, whose signs mostly agree."""

    def run(batches):
        held = None
        for batch in batches:
            table = np.stack([c.to_numpy() for c in batch.columns])
            if held is not None:
                table = np.concatenate((held, table), axis=1)
            cell, vec, low, high = table
            a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, len(cell)):
                at = np.flatnonzero(cell[:-step] == cell[step:])
                if not len(at):
                    break
                far = np.bitwise_count((low[at] ^ low[at + step]).view(np.uint64)).astype(int) + np.bitwise_count((high[at] ^ high[at + step]).view(np.uint64))
                at = at[far <= s.differ]
                a_out.append(np.minimum(vec[at], vec[at + step]))
                b_out.append(np.maximum(vec[at], vec[at + step]))
            pairs = np.unique(np.stack((np.concatenate(a_out), np.concatenate(b_out))), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            held = table[:, cell == cell[-1]] if len(cell) else None

    return run


def _group_links(s: Settings):
    """For two parts of one cell: (a, b, n) forest edges, and (a, null, n) link counts.

    A pair that also shares a cell with a smaller key is left to that one, so each
    pair counts once.
    """

    def run(key, table):
        cell, left, right = (k.as_py() for k in key)
        part, ids, times = (table.column(c).to_numpy() for c in ("part", "vec", "times"))
        x = _matrix(table.column("embedding").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        rows, columns = np.flatnonzero(part == left), np.flatnonzero(part == right)
        counts, root, edges = np.zeros(len(ids), dtype=np.int64), list(range(len(ids))), []
        others = table.column("cells").combine_chunks()
        owner, other = np.repeat(np.arange(len(ids)), others.value_lengths().to_numpy()), others.flatten().to_numpy()
        owner, other = owner[other < cell], other[other < cell]
        kinds, place, held = np.unique(other, return_inverse=True, return_counts=True)
        owner, place = owner[held[place] > 1], (np.cumsum(held > 1) - 1)[place[held[place] > 1]]
        n_kinds = int((held > 1).sum())

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def has(some: np.ndarray, first: int) -> np.ndarray:
            out = np.zeros((len(ids), min(1024, n_kinds - first)), dtype=np.float32)
            mine = (place >= first) & (place < first + out.shape[1])
            out[owner[mine], place[mine] - first] = 1
            return out[some]

        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            near = (x[some] @ x[columns].T) / (norm[some, None] * norm[columns]) >= s.least
            near &= some[:, None] != columns
            if near.any():
                for first in range(0, n_kinds, 1024):
                    near &= has(some, first) @ has(columns, first).T == 0
            counts[some] += near @ times[columns]
            if left != right:
                counts[columns] += near.T @ times[some]
            for i, js in zip(some, near, strict=True):
                for j in columns[js]:
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        edges.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        a = np.array([e[0] for e in edges] + ids.tolist(), dtype=np.int64)
        b = pa.array([e[1] for e in edges] + [None] * len(ids), pa.int64())
        return pa.table({"a": a, "b": b, "n": np.concatenate((np.zeros(len(edges), np.int64), counts))})

    return run


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row (vec_id, embedding, label).

    Links two vectors of one label and length whose cosine is ``least`` or more.
    ``n_links`` counts the other rows that a row is linked with; ``component_id``
    is the smallest vec_id that links reach; ``kept`` marks it.  Equal vectors
    form one class, which is searched once and counts as often as it stands.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    those with a null label or id, have no links and are kept.  Rows with one
    vec_id are one vector each and share its component.  Other columns are dropped,
    whatever their names; no rows: none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("times")), "classes")
    small, large = sorted_cells(classes, s)
    large = cut(large.distinct(), "dense_cells")
    mine = cut(large.groupBy("vec").agg(F.collect_set("cell").alias("cells")), "cells_of")
    parts = part_pairs(in_bounded_groups(large, "cell", "vec", s.group))
    dense = cut(parts.join(mine, "vec").join(classes, "vec").groupBy("cell", "left", "right").applyInArrow(_group_links(s), "a long, b long, n long"), "dense")

    # a vector stands in up to some fifty cells, and tasks come with vectors
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // 20_000))
    small = small.repartition(n, "cell").sortWithinPartitions("cell").select("cell", "vec", "low", "high")
    pairs = small.mapInArrow(_near_pairs(s), "a long, b long").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(mine.select(F.col("vec").alias(side), F.col("cells").alias(f"cells_{side}")), side, "left")
    pairs = pairs.where(~F.coalesce(F.arrays_overlap("cells_a", "cells_b"), F.lit(False))).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("vec").alias(side), F.col("embedding").alias(f"x_{side}"), F.col("times").alias(f"n_{side}")), side)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    cosine = dot("x_a", "x_b") / (F.sqrt(dot("x_a", "x_a")) * F.sqrt(dot("x_b", "x_b")))
    found = cut(pairs.where(cosine >= s.least).select("a", "b", "n_a", "n_b"), "found")

    links = dense.where("b is not null").select("a", "b").unionByName(found.select("a", "b"))
    counts = dense.where("b is null").select("a", "n").unionByName(found.select("a", F.col("n_b").alias("n"))).unionByName(found.select(F.col("b").alias("a"), F.col("n_a").alias("n")))
    counts = counts.groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.join(counts, classes.vec == counts.a, "left").drop("a")
    labels = components(links)
    named = named.join(labels, named.vec == labels.node, "left")
    named = cut(named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component_id")), "named")
    out = rows.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
