"""Approximate nearest neighbours by balanced posting lists.

1. Centroids are fitted on a bounded sample, as many as give short lists.
2. Every vector stands in the list of its nearest centroid and, near a boundary,
   in those of the others that are almost as near and lie in another direction.
   Long lists are dealt to parts, so no task holds more than a bounded number.
3. A query finds centroids by a best-first walk on a graph of neighbouring
   centroids held in memory and keeps the nearest within a ratio of the distance
   at which enough vectors are met.  Both are calibrated: a few vectors of the
   sample are searched exactly over all rows, and the number and ratio are taken
   that find the wanted share of their neighbours with the least work.
4. The lists that are left are searched exactly.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lattice import _matrix
from .shared import cut, in_bounded_groups


@dataclass(frozen=True)
class Settings:
    """``sample``: vectors that centroids are fitted on, about, at most;
    ``per_list``: vectors of a list, about; ``lists`` at most (what tasks hold);
    ``copies`` of a boundary vector within ``boundary`` times the nearest distance,
    whose centroids lie at least ``apart`` times that distance from each other;
    ``recall`` that pruning is calibrated for, on ``probes`` vectors of the sample;
    ``degree`` of the graph; ``group``: rows of a part; ``per_task``: queries that one
    task looks the lists of up for."""

    nearest: int = 10
    sample: int = 32_000
    per_list: int = 32
    lists: int = 8192
    copies: int = 4
    boundary: float = 1.1
    apart: float = 0.5
    recall: float = 0.96
    probes: int = 192
    degree: int = 24
    group: int = 1024
    per_task: int = 16
    seed: int = 5


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations; a centroid that gets nothing takes a random vector."""
    rng = np.random.default_rng(seed)
    center = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 2048], center).argmin(1) for i in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(center)
        np.add.at(sums, near, x)
        center = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return center


class Graph:
    """Centroids, each linked with its nearest ones both ways."""

    def __init__(self, center: np.ndarray, degree: int):
        self.center = center
        blocks = (_distances(center[i : i + 512], center) for i in range(0, len(center), 512))
        near = np.concatenate([np.argsort(b, axis=1, kind="stable")[:, 1 : degree + 1] for b in blocks])
        links: list[set] = [set(map(int, row)) for row in near]
        for i, row in enumerate(near):
            for j in row:
                links[j].add(i)
        self.links = [np.array(sorted(x), dtype=np.int64) for x in links]
        step = max(1, len(center) // 48)
        self.entries = np.arange(0, len(center), step)

    def search(self, q: np.ndarray, most: int, ratio: float, homes: np.ndarray, least: int) -> np.ndarray:
        """The ``most`` nearest centroids within ``ratio`` of the distance at which the
        nearer ones are home to ``least`` vectors, and more if they hold fewer; all
        centroids if those met do.  ``homes``: of how many vectors each is the nearest."""
        far = lambda ids: np.sqrt(((self.center[ids] - q) ** 2).sum(1))
        seen = np.zeros(len(self.center), dtype=bool)
        seen[self.entries] = True
        queue = list(zip(far(self.entries).tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(queue)
        found: list[tuple[float, int]] = []  # in order
        while queue:
            d, i = heapq.heappop(queue)
            if len(found) >= most and d > found[most - 1][0] and _needed(found, homes, least):
                break
            bisect.insort(found, (d, i))
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for d2, j in zip(far(new).tolist(), new.tolist(), strict=True):
                heapq.heappush(queue, (d2, j))
        needed = _needed(found, homes, least)
        if not needed:
            return np.arange(len(self.center))
        edge = ratio * found[needed - 1][0] + 1e-12
        return np.array([j for n, (d, j) in enumerate(found) if n < needed or (n < most and d <= edge)], dtype=np.int64)


def _needed(found: list[tuple[float, int]], homes: np.ndarray, least: int) -> int:
    """How many of the nearest centroids are home to ``least`` vectors; 0: not all are."""
    held = 0
    for n, (_, j) in enumerate(found):
        held += homes[j]
        if held >= least:
            return n + 1
    return 0


def posts(x: np.ndarray, center: np.ndarray, s: Settings) -> np.ndarray:
    """The lists of each vector, nearest first, -1 where it has fewer than ``copies``.

    A further list is taken if its centroid is within ``boundary`` of the nearest
    distance and no centroid taken before is nearer to it than ``apart`` times that.
    """
    out = np.full((len(x), s.copies), -1, dtype=np.int64)
    for at in range(0, len(x), 512):
        far = _distances(x[at : at + 512], center)
        k = min(2 * s.copies, far.shape[1])
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.lexsort((near, np.take_along_axis(far, near, axis=1)))
        near = np.take_along_axis(near, order, axis=1)
        d = np.take_along_axis(far, near, axis=1)
        rows, mine = np.arange(len(near)), out[at : at + 512]
        mine[:, 0] = near[:, 0]
        taken = np.zeros(near.shape, dtype=bool)
        taken[:, 0] = True
        own = center[near]
        n = np.ones(len(near), dtype=np.int64)
        for j in range(1, k):
            ok = (d[:, j] <= s.boundary * d[:, 0] + 1e-12) & (n < s.copies)
            apart = np.sqrt(((own[:, :j] - own[:, j : j + 1]) ** 2).sum(axis=2))
            ok &= ~(taken[:, :j] & (apart < s.apart * d[:, j : j + 1])).any(axis=1)
            taken[:, j] = ok
            mine[rows[ok], n[ok]] = near[ok, j]
            n += ok
    return out


def _exact(vectors: DataFrame, probes: DataFrame, s: Settings) -> DataFrame:
    """(query_id, vec_id, embedding, score): the exact neighbours of a few probes, in
    one pass over all vectors; each task sends its own nearest ones on."""
    rows = probes.toArrow()
    ids, q = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding").combine_chunks())

    def run(batches):
        best: list = [[] for _ in ids]
        for b in batches:
            x, own = _matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            for at in range(0, len(x), 4096):
                far = _distances(q, x[at : at + 4096])
                far[ids[:, None] == own[at : at + 4096]] = np.inf
                k = min(s.nearest, far.shape[1])
                near = np.argpartition(far, k - 1, axis=1)[:, :k]
                for i, js in enumerate(near):
                    best[i] = sorted([*best[i], *((far[i, j], own[at + j], x[at + j]) for j in js if np.isfinite(far[i, j]))], key=lambda r: r[:2])[: s.nearest]
        for i, found in enumerate(best):
            if found:
                yield pa.record_batch([pa.array([ids[i]] * len(found), pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.list_(pa.float64())), pa.array([r[0] for r in found], pa.float64())], ["query_id", "vec_id", "embedding", "score"])

    near = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, embedding array<double>, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= s.nearest)


def calibrated(vectors: DataFrame, probes: DataFrame, graph: Graph, homes: np.ndarray, s: Settings) -> tuple[int, float]:
    """(lists searched at most, ratio) that find ``recall`` of the probes' exact
    neighbours with the fewest rows compared."""
    truth = _exact(vectors, probes, s).select("query_id", "embedding").toArrow()  # at most probes x nearest rows
    k = len(graph.center)
    if not truth.num_rows:
        return k, np.inf
    asked = {r["vec_id"]: np.asarray(r["embedding"]) for r in probes.toArrow().to_pylist()}
    lists = posts(_matrix(truth.column("embedding").combine_chunks()), graph.center, s)
    rank, apart, far_apart = [], [], []
    for query_id, mine in zip(truth.column("query_id").to_pylist(), lists, strict=True):
        far = np.sqrt(((graph.center - asked[query_id]) ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        needed = min(k - 1, int(np.searchsorted(np.cumsum(homes[order]), s.nearest + 1)))
        far /= max(far[order[needed]], 1e-12)
        best = mine[mine >= 0][far[mine[mine >= 0]].argmin()]
        rank.append(int(np.flatnonzero(order == best)[0]) + 1)
        apart.append(far[best])
        far_apart.append(np.sort(far))
    rank, apart, best = np.array(rank), np.array(apart), (np.inf, k, np.inf)
    for ratio in np.unique(np.quantile(apart, np.linspace(s.recall, 1, 8), method="higher")):
        met = np.sort(np.where(apart <= ratio, rank, k + 1))
        most = int(met[int(np.ceil(s.recall * len(met))) - 1])
        cost = np.mean([min(most, np.searchsorted(x, ratio, side="right")) for x in far_apart])
        if most <= k and cost < best[0]:
            best = (cost, most, max(1.0, float(ratio)))
    return best[1], best[2]


def _scan(s: Settings):
    """The nearest rows of one list's part for each of its queries."""

    def run(key, asked, listed):
        queries, vectors = asked.column("query_id").to_numpy(), listed.column("vec_id").to_numpy()
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(queries) or not len(vectors):
            return empty
        q, x = _matrix(asked.column("embedding").combine_chunks()), _matrix(listed.column("embedding").combine_chunks())
        out = []
        for at in range(0, len(q), 256):
            rough = _distances(q[at : at + 256], x)
            rough[queries[at : at + 256, None] == vectors] = np.inf
            for i, row in enumerate(rough):
                k = min(s.nearest, len(row))
                edge = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= edge + 1e-6) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
                exact = np.sqrt(((x[near] - q[at + i]) ** 2).sum(1))
                order = np.lexsort((vectors[near], exact))[: s.nearest]
                out.append((np.full(len(order), queries[at + i]), vectors[near][order], exact[order]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return run


def search(vectors: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of ``vectors`` to each row of
    ``queries``, both (vec_id, embedding), by Euclidean distance in double precision.

    Every vector but the query's own id is a candidate; equal distances go to the
    smaller vec_id; fewer candidates than wanted give what there is.  Vectors that
    are null, empty, zero or hold null or non-finite components, vectors with a
    null id, and those of another length than most take no part.  Of several rows with
    one vec_id the least such vector counts, by its components in order, as a stored
    row and as a query.
    """
    spark = vectors.sparkSession

    def good(df: DataFrame) -> DataFrame:
        x = F.col("embedding").cast("array<double>")
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id is not null")
        fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
        return rows.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    stored = good(vectors)
    sizes = stored.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = sizes[0]["size"], sizes[0]["count"]
    stored = stored.where(F.size("embedding") == size)
    asked = good(queries).where(F.size("embedding") == size).withColumnRenamed("vec_id", "query_id")
    dense = 1 << 20
    some = stored.where(F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(dense)) < int(dense * min(1.0, s.sample / n)) + 1).orderBy("vec_id")
    sample = _matrix(some.select("embedding").toArrow().column("embedding").combine_chunks())
    if not len(sample):
        sample = _matrix(stored.orderBy("vec_id").limit(1).select("embedding").toArrow().column("embedding").combine_chunks())
    lists = max(1, min(s.lists, n // s.per_list, len(sample) // 4))
    index = Graph(centroids(sample, lists, s.seed), s.degree)
    graph = spark.sparkContext.broadcast(index)

    def post(batches):
        for b in batches:
            found = posts(_matrix(b.column("embedding")), graph.value.center, s)
            row, col = np.nonzero(found >= 0)
            yield pa.record_batch([pa.array(found[row, col]), b.column("vec_id").take(pa.array(row)), b.column("embedding").take(pa.array(row)), pa.array(col == 0)], ["list", "vec_id", "embedding", "home"])

    posted = cut(stored.mapInArrow(post, "list long, vec_id long, embedding array<double>, home boolean"), "posted")
    # a vector has one home, so lists that are home to k vectors hold k distinct ones
    homes = np.zeros(lists, dtype=np.int64)
    for r in posted.where("home").groupBy("list").count().collect():
        homes[r["list"]] = r["count"]
    probes = some.where(F.pmod(F.xxhash64("vec_id", F.lit(s.seed + 1)), F.lit(max(1, min(n, s.sample) // s.probes))) == 0).orderBy("vec_id").limit(2 * s.probes)
    most, ratio = calibrated(posted.where("home"), probes, index, homes, s)

    def ask(batches):
        for b in batches:
            x = _matrix(b.column("embedding"))
            for i, q in enumerate(x):
                found = graph.value.search(q, most, ratio, homes, s.nearest + 1)
                same = pa.array(np.full(len(found), i))
                yield pa.record_batch([pa.array(found), b.column("query_id").take(same), b.column("embedding").take(same)], ["list", "query_id", "embedding"])

    parts = cut(in_bounded_groups(posted.drop("home"), "list", "vec_id", s.group), "lists")
    shape = cut(parts.select("list", "part").distinct(), "shape")
    # a search is long: a task gets few queries, and more tasks come with more of them
    asked = cut(asked, "asked")
    spread = asked.repartition(max(1, -(-asked.count() // s.per_task)))
    wanted = spread.mapInArrow(ask, "list long, query_id long, embedding array<double>").join(shape, "list")
    near = wanted.groupBy("list", "part").cogroup(parts.groupBy("list", "part")).applyInArrow(_scan(s), "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= s.nearest).select("query_id", "rank", "vec_id", "score")
