"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserak.llm import ann, lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 64))
    near = base[:60] + rng.normal(scale=0.3, size=(60, 64)) * np.linspace(0.2, 1.2, 60)[:, None]
    hot = base[0] + rng.normal(scale=0.05, size=(150, 64))
    x = np.concatenate((base, near, hot, np.repeat(base[5:6], 20, axis=0))).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    bad = [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [None] * 64, 1), (5004, x[0].tolist(), None), (None, x[0].tolist(), 1), (5005, [], 1)]
    return rows, spark.createDataFrame(rows + bad, SCHEMA).repartition(3)


def test_e8_decoding():
    rng = np.random.default_rng(2)
    roots = lattice.shortest()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(1), 2)
    x = rng.normal(size=(300, 8)) * 2
    found = lattice.decode(x)
    doubled = np.rint(found * 2).astype(int)
    assert ((doubled % 2).std(axis=1) == 0).all() and (np.abs(found.sum(1) % 2) < 1e-9).all()
    own = ((x - found) ** 2).sum(1)
    assert (own[:, None] <= ((x[:, None] - found[:, None] - roots) ** 2).sum(2) + 1e-9).all() and own.max() <= 1 + 1e-9


@pytest.mark.parametrize("cell", [96, 4])
def test_near_duplicates(table, cell):
    rows, df = table
    got = lattice.near_duplicates(df.withColumn("cell", F.lit("clash")), lattice.Settings(cell=cell, group=50, recall=0.9999)).toPandas()
    assert len(got) == len(rows) + 7
    x = np.array([r[1] for r in rows], dtype=np.float64)
    label = np.array([r[2] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(component, np.where(link, component, len(x)).min(axis=1))
        if (new == component).all():
            break
        component = new
    mine = got[got.vec_id < 5000].set_index("vec_id").sort_index()
    assert mine.n_links.tolist() == link.sum(1).tolist()
    assert mine.component_id.tolist() == component.tolist()
    rest = got[~(got.vec_id < 5000)]
    assert (rest.n_links == 0).all() and rest.kept.all()


def test_blocks_follow_the_number_of_vectors():
    s = lattice.Settings()
    one, two, three = (lattice.layout(n, s) for n in (1_000, 20_000, 1_000_000))
    assert [x[0] for x in (one, two, three)] == [1, 2, 3] and one[1] < two[1] < three[1]


def test_cells_stay_small_and_find_planted_pairs(spark):
    rng = np.random.default_rng(14)
    for n in (3000, 12_000):
        x = rng.normal(size=(n, 64))
        z = rng.normal(size=(n // 10, 64))
        y = x[: n // 10] / np.linalg.norm(x[: n // 10], axis=1)[:, None]
        z -= (z * y).sum(1)[:, None] * y
        near = 0.935 * y + np.sqrt(1 - 0.935**2) * z / np.linalg.norm(z, axis=1)[:, None]
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, near)))], "vec_id long, embedding array<double>, label int").repartition(4)
        got = lattice.near_duplicates(df).where(f"vec_id >= {n}").toPandas().set_index("vec_id")
        assert (got.component_id == got.index - n).mean() >= 0.97
        classes = df.select(F.col("vec_id").alias("vec"), F.col("label").cast("long").alias("label"), "embedding")
        small, dense = lattice.sorted_cells(classes, lattice.Settings())
        assert dense.isEmpty() and small.count() < 60 * 1.2 * n


def test_repeated_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_no_vectors(spark, table):
    none = table[1].where("false")
    assert lattice.near_duplicates(none).count() == 0
    assert ann.search(none, none).count() == 0
    assert ann.search(table[1], none).count() == 0


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[100:400] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id % 50 = 0"), ann.Settings(group=100)).toPandas()
    hit = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, d[mine.vec_id], atol=1e-9) and (np.diff(mine.score) >= 0).all()
        hit += len(set(best) & set(mine.vec_id))
        if d[best[-1]] == 0:
            assert mine.vec_id.tolist() == best.tolist()
    assert hit / 600 >= 0.9


def test_small_copy_groups_give_full_rows(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(300, 16)), rng.integers(2, 10, 300), axis=0)
    n = len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for s in (ann.Settings(per_list=4), ann.Settings(per_list=4, recall=0.05)):
        got = ann.search(df, df.where("vec_id % 10 = 0"), s).toPandas()
        held = got.groupby("query_id").vec_id.nunique()
        assert set(held.index) == set(range(0, n, 10)) and (held == min(10, n - 1)).all()
        assert (got.query_id != got.vec_id).all()
    few = df.where("vec_id < 7")
    assert (ann.search(few, few, ann.Settings(per_list=1)).groupBy("query_id").count().toPandas()["count"] == 6).all()


def test_an_outlying_clump_gets_full_rows(spark, table):
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(1500, 16)), 80 + rng.normal(scale=0.01, size=(4, 16))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    odd = table[1].where("vec_id >= 5000 or vec_id is null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit("clash").alias("list"))
    twice = df.where("vec_id = 1501")  # a repeated row is one vector
    got = ann.search(df.union(odd).union(twice), df.where("vec_id >= 1500")).toPandas()
    assert got.groupby("query_id").vec_id.nunique().to_dict() == dict.fromkeys(range(1500, 1504), 10)
    assert (got[got["rank"] <= 3].vec_id >= 1500).all()


def test_pruning_keeps_recall_with_less_work(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(60, 24))[:, None] * 2 + rng.normal(scale=0.5, size=(60, 70, 24))).reshape(-1, 24)
    s, n = ann.Settings(), len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id % 20 = 0"), s).toPandas()
    hit = 0
    for q in range(0, n, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hit / (n / 20 * 10) >= 0.9
    graph = ann.Graph(ann.centroids(x, n // s.per_list, s.seed), s.degree)
    lists = ann.posts(x, graph.center, s)
    homes = np.bincount(lists[:, 0], minlength=len(graph.center))
    assert (lists[:, 0] == ann._distances(x, graph.center).argmin(1)).all() and homes.sum() == n
    found = [graph.search(q, 6, 1.5, homes, 11) for q in x[::20]]
    assert all(homes[f].sum() >= 11 for f in found)
    assert np.mean([np.isin(lists, f).sum() for f in found]) < 0.25 * n


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_the_least_vector_of_a_repeated_id_counts(spark, parts):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[5].tolist()), (7, x[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    y = x.copy()
    for i, j in ((100, 5), (7, 8)):
        y[i] = min(x[i].tolist(), x[j].tolist())
    got = ann.search(df, df.where("vec_id % 100 = 0"), ann.Settings(recall=1.0)).toPandas()
    for q in range(0, 600, 100):
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, np.sqrt(((y[mine.vec_id] - y[q]) ** 2).sum(1)), atol=1e-9)
    best = np.argsort(((y - y[100]) ** 2).sum(1))
    assert got[(got.query_id == 100) & (got["rank"] == 1)].vec_id.tolist() == [best[best != 100][0]]
