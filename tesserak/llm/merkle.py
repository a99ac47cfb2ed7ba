"""A Merkle manifest of a table: trees of digests per language, and one over these.

The node store is a folder of Parquet, partitioned by level.  Leaves are range-sorted
by tree and key, which gives each its coordinate.  An aligned run of ``fan_out`` to the
``depth`` leaves is one task's unit: the levels above it are written one after the
other, each from the level below in order of coordinates, and the run's own root is
a leaf to the next band of levels.  Proofs go the other way: a run's base nodes meet
the stored nodes of its levels, merged by coordinate, and the path of the run's root.
Memory is bounded by a run, the number of passes by the logarithm of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, numbered, shared_dir

#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass(frozen=True)
class Shape:
    """Nodes under one parent, and levels of a band (a run has fan_out ** depth nodes)."""

    fan_out: int = 2
    depth: int = 10

    @property
    def run(self) -> int:
        return self.fan_out**self.depth


def _h(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 over values, each as its UTF-8 length, a colon and itself; null as ``-``."""
    framed = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame, tree: str = "lang", changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, claim): the digest of each row, and where ``where`` holds the
    one that it would have with ``changes`` of columns (else null)."""
    values = {c: F.col(c) for c in FIELDS}
    named = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))  # a null tree sorts first
    claim = F.when(where, leaf_hash(list({**values, **(changes or {})}.values()))) if where is not None else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("tree"), leaf_hash(list(values.values())).alias("leaf"), claim.cast("string").alias("claim"))


class Store:
    """Nodes (tree, at, of, node) by level; ``of`` is how many the tree has there."""

    def __init__(self, spark: SparkSession, shape: Shape):
        self.spark, self.shape = spark, shape
        self.path = f"{shared_dir(spark)}/tesserak-{uuid.uuid4().hex}/nodes"
        self.bands = 0

    _FIELDS = "tree string, at long, of long, node string"

    def add(self, nodes: DataFrame) -> None:
        nodes.write.mode("append").partitionBy("level").parquet(self.path)

    def levels(self, first: int, last: int) -> DataFrame:
        """The nodes of levels ``first`` to ``last``; only their folders are read."""
        every = self.spark.read.schema(self._FIELDS + ", level int").parquet(self.path)
        return every.where(F.col("level").between(first, last))

    def roots(self) -> DataFrame:
        """(tree, subroot): the node of each tree's level that has but one."""
        return self.levels(0, 1 << 20).where("of = 1").select("tree", F.col("node").alias("subroot"))


def _climb(base: int, shape: Shape) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, of, first = table["tree"][0].as_py(), table["of"][0].as_py(), table["at"][0].as_py()
        nodes, level, out = table["node"].to_pylist(), base, []
        while of > 1 and level < base + shape.depth:
            nodes = [_h(nodes[i : i + shape.fan_out]) for i in range(0, len(nodes), shape.fan_out)]
            first, of, level = first // shape.fan_out, -(-of // shape.fan_out), level + 1
            out += [(level, tree, first + i, of, x) for i, x in enumerate(nodes)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["level", "tree", "at", "of", "node"]) if out else _NO_NODES

    return run


_NO_NODES = pa.table({"level": pa.array([], pa.int32()), "tree": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "of": pa.array([], pa.int64()), "node": pa.array([], pa.string())})


def build(base: DataFrame, shape: Shape = Shape()) -> Store:
    """Write all levels over the nodes (tree, at, of, node) of level 0, as far as each
    tree's root.  One pass for ``depth`` levels."""
    store = Store(base.sparkSession, shape)
    nodes = base.select(F.lit(0).alias("level"), "tree", "at", "of", "node")
    store.add(nodes)
    most = base.agg(F.max("of")).first()[0] or 0
    while most > 1 or not store.bands:
        level = store.bands * shape.depth
        grown = store.levels(level, level).where("of > 1").groupBy("tree", F.floor(F.col("at") / shape.run).alias("run"))
        store.add(grown.applyInArrow(_climb(level, shape), "level int, " + Store._FIELDS))
        store.bands += 1
        most = -(-most // shape.run)
    return store


#: What a base node gets: its siblings per level as "place:digests", the tree's root and the root of all.
_TAIL = "tree string, run long, path array<string>, subroot string, root string"


def _siblings(table: pa.Table, base: int, shape: Shape) -> Callable[[int], list[str]]:
    """A function from a base node's coordinate to its siblings in the run's levels."""
    levels: dict[int, tuple[int, int, list[str]]] = {}
    table = table.filter(pc.is_null(table["is_leaf"])).sort_by([("level", "ascending"), ("at", "ascending")])
    for level, at, of, node in zip(*(table[c].to_pylist() for c in ("level", "at", "of", "node")), strict=True):
        levels.setdefault(level, (at, of, []))[2].append(node)

    def path(i: int) -> list[str]:
        out = []
        for level in range(base, base + shape.depth):
            first, of, nodes = levels.get(level, (0, 1, []))
            if of <= 1:
                break
            place, i = i % shape.fan_out, i // shape.fan_out
            start = i * shape.fan_out - first
            out.append(f"{place}:" + "".join(x for j, x in enumerate(nodes[start : start + shape.fan_out]) if j != place))
        return out

    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root over a leaf and its siblings."""
    for entry in path:
        place, _, others = entry.partition(":")
        at = 64 * int(place)
        leaf = _h((others[:at], leaf, others[at:]))
    return leaf


def _meet(store: Store, base: DataFrame, tails: DataFrame, band: int, give, fields: str) -> DataFrame:
    """``give`` (row, path, subroot, root) for each base node of a band, run by run.

    ``base``: (tree, at, doc_id, leaf, claim); ``tails``: a path per run's root.
    """
    shape, level = store.shape, band * store.shape.depth
    inner = store.levels(level, level + shape.depth - 1)
    reach = F.element_at(F.array(*[F.lit(shape.fan_out ** (shape.depth - j)) for j in range(shape.depth)]), F.col("level") - level + 1)
    none = F.lit(None)
    nodes = inner.select("tree", F.floor(F.col("at") / reach).alias("run"), "level", "at", "of", "node", none.cast("boolean").alias("is_leaf"), none.cast("long").alias("doc_id"), none.cast("string").alias("claim"))
    rows = base.select("tree", F.floor(F.col("at") / shape.run).alias("run"), F.lit(level).alias("level"), "at", F.lit(0).cast("long").alias("of"), F.col("leaf").alias("node"), F.lit(True).alias("is_leaf"), "doc_id", "claim")

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        path = _siblings(left, level, shape)
        mine = left.filter(pc.is_valid(left["is_leaf"]))
        tail, subroot, root = (right[c][0].as_py() for c in ("path", "subroot", "root")) if right.num_rows else ([], None, None)
        return give(mine, path, tail, subroot, root)

    return nodes.unionByName(rows).groupBy("tree", "run").cogroup(tails.groupBy("tree", "run")).applyInArrow(run, fields)


def _tails(mine, path, tail, subroot, root) -> pa.Table:
    ats = mine["at"].to_pylist()
    return pa.table({"tree": mine["tree"], "run": mine["at"], "path": pa.array([path(i) + tail for i in ats], pa.list_(pa.string())), "subroot": pa.array([subroot] * len(ats), pa.string()), "root": pa.array([root] * len(ats), pa.string())})


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path array<string>"


def _proofs(with_path: bool):
    def give(mine, path, tail, subroot, root) -> pa.Table:
        proofs, folded, paths = [], [], []
        for at, leaf, claim in zip(*(mine[c].to_pylist() for c in ("at", "node", "claim")), strict=True):
            whole = path(at) + tail
            proofs.append(_h(e.partition(":")[2] for e in whole))
            folded.append(fold(claim or leaf, whole))
            paths.append(whole)
        n = len(proofs)
        out = {"doc_id": mine["doc_id"], "leaf": mine["node"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_())}
        return pa.table({**out, "path": pa.array(paths, pa.list_(pa.string()))} if with_path else out)

    return give


def _descend(store: Store, base: DataFrame, tops: DataFrame, give, fields: str) -> DataFrame:
    """``give`` for each node of level 0; ``tops``: (tree, path, subroot, root) over trees."""
    ends = None
    for band in range(store.bands - 1, -1, -1):
        level, nodes = band * store.shape.depth, None
        here = store.levels(level, level)
        done = here.where((F.col("at") == 0) & (F.col("of") <= store.shape.run) & ((F.col("of") > 1) | F.lit(band == 0)))
        tails = done.join(tops, "tree").select("tree", F.lit(0).cast("long").alias("run"), "path", "subroot", "root")
        tails = tails if ends is None else tails.unionByName(ends)
        if band == 0:
            return _meet(store, base, tails, 0, give, fields)
        nodes = here.where("of > 1").select("tree", "at", F.lit(None).cast("long").alias("doc_id"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("claim"))
        ends = cut(_meet(store, nodes, tails, band, _tails, _TAIL), f"paths-{band}")


@dataclass(frozen=True)
class Manifest:
    """Leaves with coordinates, the node stores of the trees and of the tree over them."""

    placed: DataFrame
    trees: Store
    top: Store
    subroots: DataFrame

    def proofs(self, with_path: bool = False) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf.

        ``folded_root`` goes from the row's claim, or else its leaf, over its stored
        siblings; ``verified`` says that it is the root.  ``with_path`` adds ``path``.
        """
        root = self.top.roots().select("tree", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("subroot").alias("root"))
        base = self.subroots.select(F.lit("").alias("tree"), "at", F.lit(None).cast("long").alias("doc_id"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("claim"))
        paths = _descend(self.top, base, root, _tails, _TAIL).select(F.col("run").alias("at"), "path", "root")
        tops = cut(self.subroots.join(paths, "at").select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root"), "tops")
        fields = _PROOF if with_path else _PROOF.rsplit(", ", 1)[0]
        return _descend(self.trees, self.placed, tops, _proofs(with_path), fields)


def manifest(rows: DataFrame, shape: Shape = Shape()) -> Manifest:
    """Build the trees over rows (doc_id, tree, leaf, claim), as leaves() gives them.

    In a tree leaves ascend by doc_id (null first), then leaf; a tree's root is a leaf
    of the one over all, by name of the tree.  Repeated rows are leaves of their own; a
    null text, source, count, language or id is hashed as ``-``, an empty one as
    ``0:``.  No rows: an empty manifest without a root.
    """
    placed = cut(numbered(cut(rows, "leaves"), "tree", ["doc_id", "leaf"], "at"), "placed")
    trees = build(placed.withColumnRenamed("leaf", "node"), shape)
    subroots = cut(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), "subroots")
    subroots = cut(numbered(subroots, "tree", ["name"], "at"), "subroots")
    return Manifest(placed, trees, build(subroots, shape), subroots)
