"""Communities against exhaustive search and by their own promises."""

import itertools
import random

import pytest

from tesserak.operators import graph

EDGES = "from_id string, to_id string, weight double"


def groups_of(spark, edges, resolution=0.5):
    got = graph.communities(spark.createDataFrame(edges, EDGES), resolution).collect()
    assert len({r.node for r in got}) == len(got)
    out = {}
    for r in got:
        out.setdefault(r.community, set()).add(r.node)
    assert all(name == min(held) for name, held in out.items())
    return list(out.values())


def quality(groups, edges, resolution=0.5):
    weight = {}
    for a, b, w in edges:
        if a != b and w > 0:
            weight[frozenset((a, b))] = weight.get(frozenset((a, b)), 0) + w
    return sum(sum(weight.get(frozenset(p), 0) for p in itertools.combinations(g, 2)) - resolution * len(g) * (len(g) - 1) / 2 for g in groups)


def assert_settled(groups, edges):
    """No move of a node, no split of one and no merge of two groups is better."""
    best = quality(groups, edges)
    for i, g in enumerate(groups):
        for node in g:
            rest = [*groups[:i], g - {node}, *groups[i + 1 :]]
            assert quality([*rest, {node}], edges) <= best + 1e-6
            for j in range(len(groups)):
                if j != i:
                    assert quality([x | {node} if k == j else x for k, x in enumerate(rest)], edges) <= best + 1e-6
    for a, b in itertools.combinations(range(len(groups)), 2):
        assert quality([*(g for k, g in enumerate(groups) if k not in (a, b)), groups[a] | groups[b]], edges) <= best + 1e-6


def partitions(items):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for p in partitions(rest):
        yield [{first}, *p]
        for i in range(len(p)):
            yield [*p[:i], p[i] | {first}, *p[i + 1 :]]


@pytest.mark.parametrize("n", [30, 120])
def test_a_clique_is_one_community(spark, n):
    edges = [(f"n{a:04}", f"n{b:04}", 1.0) for a, b in itertools.combinations(range(n), 2)]
    assert groups_of(spark, edges) == [{f"n{i:04}" for i in range(n)}]


def test_a_large_clique_is_one_community(spark):
    ids = spark.range(1000).selectExpr("concat('n', lpad(id, 4, '0')) as a")
    edges = ids.crossJoin(ids.withColumnRenamed("a", "b")).where("a < b").selectExpr("a as from_id", "b as to_id", "1.0D as weight")
    assert graph.communities(edges).select("community").distinct().count() == 1


def test_small_graphs_are_as_good_as_any_partition(spark):
    rnd = random.Random(2)
    edges, nodes = [], []
    for g in range(6):
        own = [f"g{g}-{i}" for i in range(7)]
        nodes.append(own)
        edges += [(a, b, rnd.choice([0.2, 0.6, 1.0])) for a, b in itertools.combinations(own, 2) if rnd.random() < 0.55]
    got = groups_of(spark, edges)
    found = best = 0.0
    for own in nodes:
        mine = [e for e in edges if e[0] in own]
        held = [g for g in got if g <= set(own)]
        assert_settled(held, mine)
        found += quality(held, mine)
        best += max(quality(p, mine) for p in partitions(sorted({x for e in mine for x in e[:2]})))
    assert found >= 0.97 * best


def test_dense_groups_in_a_sparse_graph(spark):
    rnd = random.Random(5)
    groups = [[f"c{g:02}-{i:02}" for i in range(size)] for g, size in enumerate((5, 8, 12, 20, 30))]
    edges = [(a, b, 1.0) for g in groups for a, b in itertools.combinations(g, 2) if rnd.random() < 0.9]
    every = [x for g in groups for x in g]
    edges += [(*rnd.sample(every, 2), 1.0) for _ in range(60)] + [("lone", "lone", 3.0), ("hub", "leaf", 0.0), ("c00-00", "c00-01", -2.0)]
    got = groups_of(spark, edges)
    assert {frozenset(g) for g in groups[2:]} <= {frozenset(g) for g in got} and {"lone"} in got and {"hub"} in got and {"leaf"} in got
    assert quality(got, edges) >= quality([set(g) for g in groups], edges)
    assert_settled(got, edges)


def test_a_hub_takes_some_leaves_only(spark):
    edges = [("hub", f"leaf{i:02}", 1.0) for i in range(40)]
    got = groups_of(spark, edges)
    assert_settled(got, edges)
    assert max(map(len, got)) <= 4
