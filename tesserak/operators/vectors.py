"""Vector operators: top-k, exact threshold pairs, coverage, reuse, hashed embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import cut


#: Texts that are taken out of a batch at once, and vectors compared at once.
PIECE, ROWS = 128, 2048


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows (vec_id, embedding) nearest by cosine; a bounded top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, most: int = 64 << 20) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows by cosine of each query.

    ``vectors``: (vec_id, embedding), where rows of one vec_id count by their nearest;
    ``queries``: (query_id, embedding).  Queries go to every task in blocks of ``most``
    bytes, one block after the other.  A task compares its rows with a block and sends
    only its own k nearest on.
    """
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = 8 * (asked.agg(F.sum(F.size("embedding"))).first()[0] or 0)
    blocks = max(1, math.ceil(size / most))
    near = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = _nearest(vectors, block, k)
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    rows = block.orderBy("query_id").collect()
    if not rows:
        return block.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    ids, q = [r.query_id for r in rows], np.array([r.embedding for r in rows])
    shared = block.sparkSession.sparkContext.broadcast((q, np.maximum((q * q).sum(axis=1), 1e-300)))

    def run(batches):
        q, norms = shared.value
        best, least = [np.zeros((0, 2))] * len(ids), np.full(len(ids), -np.inf)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x, own = flat.reshape(b.num_rows, -1), b.column("vec_id").to_numpy()
            order = np.argsort(own, kind="stable")
            x, own = x[order], own[order]
            starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
            size = np.maximum((x * x).sum(axis=1), 1e-300)
            for at in range(0, len(ids), 64):
                near = np.round(q[at : at + 64] @ x.T / np.sqrt(norms[at : at + 64, None] * size), 9)
                near = np.maximum.reduceat(near, starts, axis=1)
                # a query gains nothing from rows that are all farther than its k nearest so far
                for i in np.flatnonzero(near.max(axis=1) >= least[at : at + 64]):
                    row = near[i]
                    edge = np.partition(row, max(0, len(row) - k))[max(0, len(row) - k)]
                    take = np.flatnonzero(row >= edge)
                    got = np.concatenate((best[at + i], np.stack((row[take], own[starts[take]]), axis=1)))
                    got = got[np.lexsort((got[:, 1], -got[:, 0]))]
                    _, first = np.unique(got[:, 1], return_index=True)
                    best[at + i] = got[np.sort(first)][:k]
                    least[at + i] = best[at + i][-1, 0] if len(best[at + i]) == k else -np.inf
        for i, got in enumerate(best):
            if len(got):
                yield pa.record_batch([pa.array([ids[i]] * len(got), pa.int64()), pa.array(got[:, 1].astype(np.int64)), pa.array(got[:, 0])], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id long, vec_id long, score double")


def embedded(rows: DataFrame, dims: int = 64) -> DataFrame:
    """(id, embedding): signed feature hashing of texts (id, text), not scaled.

    A token (letters, digits, ``_`` and ``-``, without accents, in lower case) counts at
    the first two bytes of its SHA-256 modulo ``dims``, negatively if byte three is odd.
    Texts without tokens are left out.  The numbers are whole, so cosines of them are
    the same on every engine.
    """
    import re
    import unicodedata
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa

    # accents begin at U+0300
    token, high = re.compile(r"[\w-]+"), re.compile("[\u0300-\U0010ffff]+")

    def without_accents(found: re.Match) -> str:
        return "".join(c for c in found[0] if unicodedata.category(c) != "Mn")

    class Places(dict):
        """Twice the place of a word, one more where it counts negatively."""

        def __missing__(self, word: str) -> int:
            if len(self) >= 1 << 16:
                self.clear()
            digest = sha256(word.encode()).digest()
            self[word] = 2 * (int.from_bytes(digest[:2]) % dims) + digest[2] % 2
            return self[word]

    def run(batches):
        places = Places()
        # a batch has as many texts as the session says; only some are Python's at once
        for b in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            ids, out = [], []
            for key, value in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                bare = value or ""
                if not bare.isascii():
                    bare = high.sub(without_accents, unicodedata.normalize("NFD", bare))
                at = [places[w] for w in token.findall(bare.lower())]
                if at:
                    ids.append(key)
                    out.append(np.bincount(at, minlength=2 * dims))
            if ids:
                both = np.stack(out).astype(np.int32)
                flat = pa.array((both[:, ::2] - both[:, 1::2]).ravel())
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(np.arange(0, dims * len(ids) + 1, dims, dtype=np.int32), flat)], ["id", "embedding"])

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, embedding array<int>")


def near_duplicate_pairs(vectors: DataFrame, least: float, per_pivot: int = 1024, pivots: int = 1024, part: int = 16_384, turn: int = 65_536) -> DataFrame:
    """(a, b, score): pairs of vectors (vec_id, embedding) with cosine >= least, exactly,
    a < b.

    Every vector has the nearest of some pivots as its home, and a home's radius is its
    farthest vector's angle.  By the triangle inequality a vector x has partners at home
    h only if its angle to that pivot is at most the radius and the wanted angle
    together.  Homes are packed into cells of about ``part`` vectors, or dealt to several
    if they have more; x is sent once to each cell with such a home, and is compared there
    with the residents of such homes, by blocks.  Of two homes the later one compares.
    Vectors in clusters meet few homes.  In data without any structure, or for a low
    ``least``, all homes are within reach, and the join is a product in blocks: angles
    then hardly differ, and no bound on them can tell pairs apart; what is sent is then
    the vectors times the cells, and visitors come by turns of about ``turn``.  Scores
    are taken where pairs are found, so no pair carries its vectors on.  Pivots are one
    vector in ``per_pivot``, ``pivots`` at most, so they fit every task.
    Vectors that are null or zero, or whose length isn't the usual one, have no pairs.
    """
    import numpy as np
    import pyarrow as pa

    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.exists("embedding", lambda v: v != 0))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    if usual is None:
        return none
    rows = cut(rows.where(F.size("embedding") == usual["n"]))
    wanted = max(1, min(pivots, -(-usual["count"] // per_pivot)))
    chosen = rows.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(wanted).collect()
    centre = np.array([r.embedding for r in chosen])
    shared = vectors.sparkSession.sparkContext.broadcast(centre / np.linalg.norm(centre, axis=1)[:, None])

    def raw(b) -> np.ndarray:
        flat = b.column("embedding").combine_chunks() if isinstance(b.column("embedding"), pa.ChunkedArray) else b.column("embedding")
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def angles(b) -> np.ndarray:
        v = raw(b)
        return np.arccos(np.clip(v / np.linalg.norm(v, axis=1)[:, None] @ shared.value.T, -1, 1))

    def homes(batches):
        for b in batches:
            far = angles(b)
            home = far.argmin(axis=1)
            yield pa.record_batch([b.column("vec_id"), b.column("embedding"), pa.array(home), pa.array(far[np.arange(len(home)), home])], ["vec_id", "embedding", "home", "angle"])

    at_home = cut(rows.mapInArrow(homes, "vec_id long, embedding array<double>, home long, angle double"))
    held = {r.home: (r.radius, r.n) for r in at_home.groupBy("home").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([held.get(i, (-np.inf, 0))[0] for i in range(len(centre))])
    reach = math.acos(min(1.0, max(-1.0, least))) + 1e-6
    # homes in turn fill a cell; one that is too large has cells of its own
    first, dealt, filled, cells = np.zeros(len(centre), np.int64), np.ones(len(centre), np.int64), part, 0
    for h, (_, n) in sorted(held.items()):
        dealt[h] = -(-n // part)
        if filled + n > part:
            cells, filled = cells + int(dealt[h]), 0
            first[h] = cells - dealt[h]
        else:
            first[h] = cells - 1
        filled = part if dealt[h] > 1 else filled + n
    heirs = [[] for _ in range(cells)]
    for h in sorted(held):
        for c in range(first[h], first[h] + dealt[h]):
            heirs[c].append(h)

    def met(b) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each visit."""
        home = b.column("home").to_numpy()
        near = (angles(b) <= radius + reach) & (np.arange(len(radius)) >= home[:, None])
        found = [np.flatnonzero(near[:, h].any(axis=1)) for h in heirs]
        return np.concatenate(found), np.repeat(np.arange(cells), [len(f) for f in found])

    def counted(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            total += np.bincount(met(b)[1], minlength=cells)
        yield pa.record_batch([pa.array(np.arange(cells)), pa.array(total)], ["cell", "n"])

    visitors = {r.cell: r.n for r in at_home.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    turns = np.array([max(1, -(-visitors.get(c, 0) // turn)) for c in range(cells)])

    def dealt_out(b, row, cell, at):
        for i in range(0, len(row), 20_000):
            take = pa.array(row[i : i + 20_000])
            yield pa.record_batch([pa.array(cell[i : i + 20_000]), pa.array(at[i : i + 20_000]), *(b.column(n).take(take) for n in ("vec_id", "embedding", "home"))], ["cell", "turn", "vec_id", "embedding", "home"])

    def spread(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

    def sent(batches):
        for b in batches:
            row, cell = met(b)
            yield from dealt_out(b, row, cell, (spread(b.column("vec_id").to_numpy())[row] % turns[cell].astype(np.uint64)).astype(np.int64))

    def resident(batches):
        for b in batches:
            home = b.column("home").to_numpy()
            cell = first[home] + (spread(b.column("vec_id").to_numpy()) % dealt[home].astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), turns[cell])
            at = np.arange(len(row)) - np.repeat(np.cumsum(turns[cell]) - turns[cell], turns[cell])
            yield from dealt_out(b, row, cell[row], at)

    schema = "cell long, turn long, vec_id long, embedding array<double>, home long"
    visits, residents = at_home.mapInArrow(sent, schema), at_home.mapInArrow(resident, schema)

    def summed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Dot products of rows, summed in order, as cosine() sums them."""
        total = np.zeros(len(v))
        for d in range(v.shape[1]):
            total += v[:, d] * w[:, d]
        return total

    def compared(key, left, right):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            own, ids = right.column("vec_id").to_numpy(), left.column("vec_id").to_numpy()
            there, home, x, y = right.column("home").to_numpy(), left.column("home").to_numpy(), raw(left), raw(right)
            long, size = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            for h in np.unique(there):
                far = np.arccos(np.clip(x @ shared.value[h] / long, -1, 1))
                some, inside = np.flatnonzero((home <= h) & (far <= radius[h] + reach)), np.flatnonzero(there == h)
                for at in range(0, len(some), 512):
                    mine = some[at : at + 512]
                    i, j = np.nonzero(x[mine] @ y[inside].T >= (least - 1e-9) * np.outer(long[mine], size[inside]))
                    i, j = mine[i], inside[j]
                    once = (ids[i] != own[j]) & ((home[i] < h) | (ids[i] < own[j]))
                    pairs = i[once], j[once]
                    for few in range(0, len(pairs[0]), 20_000):  # copies may all be pairs
                        i, j = (k[few : few + 20_000] for k in pairs)
                        score = summed(x[i], y[j]) / (np.sqrt(summed(x[i], x[i])) * np.sqrt(summed(y[j], y[j])))
                        kept = score >= least
                        out.append((np.minimum(ids[i], own[j])[kept], np.maximum(ids[i], own[j])[kept], score[kept]))
        a, b, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "score": score})

    pairs = visits.groupBy("cell", "turn").cogroup(residents.groupBy("cell", "turn")).applyInArrow(compared, "a long, b long, score double")
    return pairs.select("a", "b", F.round("score", 6).alias("score"))


def embedding_coverage(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """Expected, stored and matching vectors in one pass.

    ``units``: (unit_id, hash); ``vectors``: (unit_id, hash).
    """
    v = vectors.select(F.col("unit_id").alias("_id"), F.col("hash").alias("_hash"))
    met = units.join(v, units.unit_id == v._id, "full_outer")
    return met.agg(F.count("unit_id").alias("expected"), F.count("_id").alias("stored"), F.count_if(F.col("hash") == F.col("_hash")).alias("matching"))


def embedding_reuse(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each unit (unit_id, hash) the newest vector with its hash, or null.

    ``vectors``: (vector_id, hash, generation).  The newest is a max_by aggregate,
    combined before the shuffle, so a common hash is one row in the join.
    """
    newest = vectors.groupBy("hash").agg(F.max(F.struct("generation", "vector_id")).alias("best"))
    return units.join(newest, "hash", "left").select("unit_id", F.col("best.vector_id").alias("vector_id"), F.col("best").isNull().alias("to_compute"))


def hash_embedding(docs: DataFrame, dims: int = 32) -> DataFrame:
    """(doc_id, idx, value): signed feature hashing of tokens, with unit length.

    A token's index is the first two bytes of its sha256 modulo ``dims`` and its
    sign the parity of byte three.
    """
    words = docs.select("doc_id", F.explode(text.tokens(F.col("body"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    digest = F.sha2("token", 256)
    idx = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % dims).alias("idx")
    odd = F.conv(F.substring(digest, 5, 2), 16, 10).cast("long") % 2
    signed = F.when(odd == 0, F.col("n")).otherwise(-F.col("n"))
    sums = words.select("doc_id", idx, signed.alias("v")).groupBy("doc_id", "idx").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")).cast("double"))
    return sums.where("v <> 0").withColumn("norm", norm).select("doc_id", "idx", F.round(F.col("v") / F.col("norm"), 6).alias("value"))


def l2_violations(vectors: DataFrame, dims: int, eps: float = 1e-3) -> DataFrame:
    """Rows whose length isn't ``dims`` or whose norm isn't 1."""
    bad = (F.size("embedding") != dims) | (F.abs(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) - 1) >= eps)
    return vectors.where(bad).select("vec_id")
