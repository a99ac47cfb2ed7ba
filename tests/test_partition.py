"""The partition as a whole: every node, stable keys, quality and supporting edges."""

import hashlib

import oracle
import pytest

from tesserak.operators import graph
from tesserak.plans import analytics

EDGES = [
    ("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "a", "s", 1.0), ("a", "b", "q", 0.5), ("a", "a", "r", 9.0),
    ("x", "y", "r", None), ("y", "z", "r", float("nan")), ("z", "x", "r", float("inf")), ("x", "a", "r", 0.0), ("y", "b", "r", -3.0),
    ("lone", "ghost", "r", 5.0), ("ghost", "other", "r", 5.0), ("lone", None, "r", 5.0),
]


def key(members):
    return "community:" + hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()[:20]


def test_memberships_of_known_nodes(spark):
    edges = spark.createDataFrame(EDGES, "from_id string, to_id string, relation string, weight double")
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "x", "y", "z", "lone", "bare", "bare", None)], "node string")
    got = {r.node: r for r in graph.memberships(edges, graph.communities(edges, nodes=nodes), nodes=nodes).collect()}
    assert sorted(got) == ["a", "b", "bare", "c", "lone", "x", "y", "z"]
    for members, inside in (("abc", 3.5), ("xyz", 3.0), (["lone"], 0.0), (["bare"], 0.0)):
        for n in members:
            r = got[n]
            assert (r.community, r.community_key, r.size) == (min(members), key(members), len(members))
            assert r.inside == inside and r.quality == pytest.approx(inside - 0.5 * len(members) * (len(members) - 1) / 2)
    assert {n: r.support_edges for n, r in got.items()} == {"a": "a|q|b,a|r|b", "b": "b|r|c", "c": "c|s|a", "x": "x|r|y", "y": "y|r|z", "z": "z|r|x", "lone": "", "bare": ""}


def test_every_node_of_the_tables_is_placed_once(spark):
    d = oracle.sf("sf0.001")
    got = analytics.leiden_communities(spark, d).collect()
    tables = {"R": ("region", "r_regionkey"), "N": ("nation", "n_nationkey"), "S": ("supplier", "s_suppkey"), "C": ("customer", "c_custkey")}
    want = [f"{kind}:{r[0]}" for kind, (name, c) in tables.items() for r in spark.read.parquet(f"{d}/{name}.parquet").select(c).collect()]
    assert sorted(r.node for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.community, []).append(r.node)
    assert all(r.community_key == key(held[r.community]) and r.size == len(held[r.community]) for r in got)
    inner = [e for r in got for e in r.support_edges.split(",") if e]
    home = {r.node: r.community for r in got}
    assert inner and len(set(inner)) == len(inner) and all(home[e.split("|")[0]] == home[e.split("|")[2]] for e in inner)
