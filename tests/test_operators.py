"""Operators on small literals with results worked out by hand."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserak.functions import text
from tesserak.operators import codegraph, evaluation, filters, graph, ordered, retrieval, truth, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scope_filter(spark):
    docs = spark.createDataFrame([(1, "a", "x/y"), (2, "a", "x/yz"), (3, "b", "q"), (4, "c", "x")], "doc_id long, vault string, path string")
    scopes = spark.createDataFrame([("a", "x/y"), ("b", None)], "vault string, prefix string")
    assert [r.doc_id for r in filters.scope_filter(docs, scopes).orderBy("doc_id").collect()] == [1, 3]


def test_trust_rank(spark):
    df = spark.createDataFrame([("ATTESTED",), ("UNVERIFIED",), ("odd",), (None,)], "trust string")
    assert rows(filters.trust_filter(df, "MACHINE_SUPPORTED")) == [("ATTESTED",)]


def test_rrf_counts_best_rank_once(spark):
    c = spark.createDataFrame([(1, 7, "exact", 1), (1, 7, "exact", 4), (1, 8, "lexical", 1), (1, 7, "lexical", 2)], "query_id long, doc_id long, channel string, rank long")
    got = {r.doc_id: r.score for r in retrieval.rrf_fuse(c).collect()}
    assert got[7] == pytest.approx(3 / 61 + 1.5 / 62, abs=1e-8)
    assert got[8] == pytest.approx(1.5 / 61, abs=1e-8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations([(1, i, c, r) for i in range(3) for c, r in (("exact", i + 1), ("lexical", 3 - i), ("raw", 2))]))
def test_rrf_ignores_order(spark, order):
    c = spark.createDataFrame(order, "query_id long, doc_id long, channel string, rank long")
    assert rows(retrieval.rrf_fuse(c)) == rows(retrieval.rrf_fuse(spark.createDataFrame(sorted(order), c.schema)))


def test_expand_graph_chain(spark):
    e = spark.createDataFrame([("A", "B", "uses", 1.0), ("B", "C", "uses", 1.0), ("C", "D", "uses", 1.0)], "from_id string, to_id string, relation string, weight double")
    s = spark.createDataFrame([("A",)], "seed string")
    assert rows(graph.expand_graph(s, e)) == [("B", 0.5), ("C", 0.25), ("D", 0.125)]
    assert rows(graph.best_paths(s, e)) == [("A", "B", 1, "A>B"), ("A", "C", 2, "A>B>C"), ("A", "D", 3, "A>B>C>D")]
    assert rows(graph.closure(spark.createDataFrame([("D",)], "seed string"), e)) == [("A", 3), ("B", 2), ("C", 1)]
    assert {r[1] for r in rows(graph.connected_components(e))} == {"A"}


def test_ppr_conserves_mass(spark):
    e = spark.createDataFrame([("A", "B", "r", 1.0), ("B", "C", "r", 2.0), ("A", "C", "r", 1.0)], "from_id string, to_id string, relation string, weight double")
    s = spark.createDataFrame([("A", 2.0)], "seed string, weight double")
    got = dict(rows(graph.ppr(s, e, rounds=4)))
    assert sum(got.values()) == pytest.approx(1, abs=1e-6)
    assert got["A"] > got["B"]


def test_communities_are_connected(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [("c", "x", 0.3)], "from_id string, to_id string, weight double")
    got = {r.node: r.community for r in graph.communities(e).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["x"] == got["y"] == got["z"] == "x"
    quality = {r.community: r.quality for r in graph.community_quality(e, graph.communities(e)).collect()}
    assert quality == {"a": 1.5, "x": 1.5}


def test_near_duplicate_pairs_miss_none(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64))
    x[20:] = x[:20] + rng.normal(scale=0.2, size=(20, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if x[i] @ x[j] >= 0.95}
    assert want and {(r.a, r.b) for r in vectors.near_duplicate_pairs(df, 0.95).collect()} == want


def test_intervals(spark):
    df = spark.createDataFrame([(1, "k", "p", 0.0, 10.0), (2, "k", "q", 9.0, 30.0), (3, "k", "q", 10.0, 12.0), (4, "j", "q", 0.0, 99.0)], "id long, key string, object string, start double, end double")
    assert rows(truth.interval_overlap_pairs(df, ["key"], 4)) == [(1, 2)]


def test_support_cycle_stays_unsupported(spark):
    sets = spark.createDataFrame([("a", 0, "FACT", "b"), ("b", 0, "FACT", "a"), ("c", 0, "EVIDENCE", "e"), ("d", 0, "FACT", "c"), ("d", 1, "EVIDENCE", "bad")], "set_id string, group_no int, ref_kind string, ref_id string")
    states = spark.createDataFrame([("bad", 0)], "ref_id string, level int")
    assert rows(truth.support_eval(sets, states)) == [("a", "UNSUPPORTED"), ("b", "UNSUPPORTED"), ("c", "SUPPORTED"), ("d", "SUPPORTED")]


def test_support_of_long_chains(spark):
    chain = [(f"s{i:02}", 0, "FACT", f"s{i + 1:02}") for i in range(60)] + [("s60", 0, "EVIDENCE", "good")]
    ladder = [x for i in range(26) for x in ((f"t{i:02}", 0, "FACT", f"t{i + 1:02}"), (f"t{i:02}", 1, "EVIDENCE", "bad"))] + [("t26", 0, "EVIDENCE", "half")]
    loop = [("u0", 0, "FACT", "u1"), ("u1", 0, "FACT", "u2"), ("u2", 0, "FACT", "u0"), ("v", 0, "FACT", "u1"), ("v", 1, "EVIDENCE", "half")]
    sets = spark.createDataFrame(chain + ladder + loop, "set_id string, group_no int, ref_kind string, ref_id string")
    states = spark.createDataFrame([("bad", 0), ("half", 1)], "ref_id string, level int")
    got = dict(rows(truth.support_eval(sets, states)))
    assert {got[f"s{i:02}"] for i in range(61)} == {"SUPPORTED"} and {got[f"t{i:02}"] for i in range(27)} == {"DISPUTED"}
    assert {got[f"u{i}"] for i in range(3)} == {"UNSUPPORTED"} and got["v"] == "DISPUTED"


def test_gap_blocks(spark):
    df = spark.createDataFrame([("c", 1, "o", "UPSERT", 1.0), ("c", 2, "o", "DELETE", 2.0), ("c", 4, "o", "UPSERT", 3.0)], "connector string, sequence long, object string, change string, value double")
    assert rows(ordered.apply_changes(ordered.gap_free_prefix(df))) == [("c", "o", 2, True, None)]


def test_retry_delay(spark):
    df = spark.range(1).select(ordered.retry_delay(F.lit(3), F.lit(0.5)).alias("a"), ordered.retry_delay(F.lit(20), F.lit(1.0)).alias("b"))
    assert tuple(df.first()) == (4.0, 300.0)


def test_scores(spark):
    cases = spark.createDataFrame([(1, [5, 6]), (2, [])], "query_id long, gold array<long>")
    ranked = spark.createDataFrame([(1, 9, 1), (1, 5, 2)], "query_id long, doc_id long, rank long")
    got = {r.query_id: r for r in evaluation.score_retrieval(cases, ranked).collect()}
    assert (got[1].recall, got[1].rr, got[2].recall) == (0.5, 0.5, 1.0)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-5)


def test_text(spark):
    df = spark.createDataFrame([("getHTTPResponse_code", "see [[a/b.md#x|y]] and [[c]]", " A-b C ")], "s string, w string, i string")
    got = df.select(text.symbol_text(F.col("s")), text.wiki_links(F.col("w")), text.normalize_identity(F.col("i"))).first()
    assert tuple(got) == ("get http response code", ["a/b", "c"], "abc")


def test_tool_selection(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "a", "c"])], "case_id long, expected array<string>, used array<string>")
    assert rows(evaluation.tool_selection(df)) == [(1, 2, 1, False)]


SYMBOLS = "symbol_id long, repo string, kind string, path string, name string, qualified_name string, signature string, line long, hash string"


def test_commit_delta(spark):
    old = spark.createDataFrame([(1, "r", "fn", "a.py", "f", "m.f", "f()", 1, "h1"), (2, "r", "fn", "a.py", "g", "m.g", "g()", 5, "h2"), (3, "r", "fn", "b.py", "z", "m.z", "z()", 5, "h4")], SYMBOLS)
    new = spark.createDataFrame([(4, "r", "fn", "a.py", "f", "m.f", "f()", 1, "h1"), (5, "r", "fn", "a.py", "k", "m.k", "k()", 9, "h3"), (6, "r", "fn", "b.py", "z", "m.z", "z()", 5, "h4")], SYMBOLS)
    assert rows(codegraph.commit_delta(old, new)) == [("a.py", "fn", "f", "CHANGED"), ("a.py", "fn", "g", "REMOVED"), ("a.py", "fn", "k", "ADDED")]


def test_reconciliation(spark):
    old = spark.createDataFrame([(1, "r", "fn", "a.py", "f", "m.f", "f(x)", 1, "h1"), (2, "r", "fn", "a.py", "g", "m.g", "g()", 7, "h2"), (3, "r", "fn", "c.py", "p", "m.p", "p()", 1, "h5"), (4, "r", "fn", "d.py", "p", "m.p", "p()", 1, "h5")], SYMBOLS)
    new = spark.createDataFrame([(5, "r", "fn", "b.py", "f", "n.f", "f(x)", 3, "h1"), (6, "r", "fn", "a.py", "h", "m.h", "h()", 7, "h3"), (7, "r", "fn", "e.py", "p", "m.p", "p()", 1, "h5"), (8, "q", "fn", "b.py", "f", "n.f", "f(x)", 3, "h1")], SYMBOLS)
    assert rows(codegraph.reconcile(old, new)) == [(1, 5, "MOVED_FROM", "CANDIDATE", 190, 0.98), (2, 6, "RENAMED_FROM", "CANDIDATE", 20, 0.45), (3, 7, "MOVED_FROM", "AMBIGUOUS", 290, 0.98), (4, 7, "MOVED_FROM", "AMBIGUOUS", 290, 0.98)]


def test_lexical_search_needs_every_term(spark):
    docs = spark.createDataFrame([(1, "DOC-1", "a/1.md", "red fox", "the red fox\nruns far"), (2, "DOC-2", "a/2.md", "fox", "a fox\nthat is red"), (3, "DOC-3", "a/3.md", "red", None)], "doc_id long, external_id string, path string, title string, body string")
    queries = spark.createDataFrame([(9, ["red", "fox"]), (8, ["doc", "3"]), (7, ["fox", "nowhere"]), (6, [])], "query_id long, terms array<string>")
    assert rows(retrieval.lexical_search(docs, queries)) == [(8, 3, 32.0, "lexical:external-id-terms"), (9, 1, 23.0, "lexical:title-terms"), (9, 2, 2.0, "lexical:body-terms")]


def test_one_line(spark):
    df = spark.createDataFrame([(" a\n b ",), ("word " * 100,), ("x" * 400,)], "t string")
    got = [r[0] for r in df.select(retrieval.one_line(F.col("t"), 20)).collect()]
    assert got == ["a b", "word word word word…", "x" * 19 + "…"]


def test_front_matter_and_redaction(spark):
    from tesserak.functions import documents as doc

    df = spark.createDataFrame([("---\nid: 1\nstatus: a\nstatus: b: c\n---\nbody",), ("no block",)], "t string")
    assert [r[0] for r in df.select(doc.front_matter(F.col("t"))).collect()] == [{"id": "1", "status": "b: c"}, {}]
    df = spark.createDataFrame([({"b": "x" * 9, "api_key_token": "s", "logPath": "C:\\x", "path": "rel", "a": None},)], "p map<string,string>")
    clean = doc.redacted(F.col("p"), 5)
    assert df.select(clean).first()[0] == {"b": "xxxxx…[TRUNCATED]", "path": "rel", "a": None}
    assert df.select(doc.joined_path(F.lit("a/b"), F.lit("../c/./d"))).first()[0] == "a/c/d"


def test_topk_batch_matches_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(q, int(i)) for q in range(5) for i in np.argsort(-np.round(u @ u[q], 9), kind="stable")[:7]}
    assert {(r.query_id, r.vec_id) for r in vectors.topk_batch(df, asked, 7).collect()} == want
    assert {(r.query_id, r.vec_id) for r in vectors.topk_batch(df, asked, 7, most=100).collect()} == want


def test_coverage_links(spark):
    ran = spark.createDataFrame([("a.py", "f", 2), ("a.py", "f", 3), ("a.py", "g", 0), ("b.py", "x", 1)], "path string, function string, count long")
    nodes = spark.createDataFrame([("n1", "a.py", "f"), ("n2", "b.py", "x"), ("n3", "b.py", "x")], "node_id string, path string, name string")
    assert rows(codegraph.coverage_links(ran, nodes)) == [("a.py", "f", 5, "n1", "LINKED"), ("b.py", "x", 1, None, "AMBIGUOUS")]


def test_exact_lookup_by_alias_and_abbreviation(spark):
    docs = spark.createDataFrame([(1, "DOC-SRP", ["One Thing"], "T1", "a.md"), (2, "DOC-2", ["CQRS"], "t1", "b.md"), (3, "DOC-3", ["CQRS", "x"], None, "c.md"), (4, None, None, None, None)], "doc_id long, external_id string, aliases array<string>, title string, path string")
    asked = spark.createDataFrame([(1, "one THING"), (2, "what is SRP here"), (3, "what is CQRS here"), (4, "CQRS"), (5, "T1"), (6, "B.MD"), (7, "SRP"), (8, "doc-2 X")], "query_id long, lookup string")
    assert rows(retrieval.exact_lookup(docs, asked)) == [(1, 1, 1), (2, 1, 4), (4, 2, 1), (4, 3, 1), (5, 1, 2), (5, 2, 2), (6, 2, 3)]


def test_ppr_push_is_within_its_tolerance(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    n = 40
    pairs = [(int(a), int(b), "r", float(w)) for a, b, w in zip(rng.integers(0, 30, 140), rng.integers(0, n, 140), rng.uniform(0.1, 2, 140), strict=True)] + [(0, 1, "r", 0.0), (1, 2, "q", 3.0), (1, 2, "q", 1.0)]
    seeds = [(1, 0, 2.0), (1, 5, 1.0), (2, 35, 1.0), (3, 999, 1.0), (4, 3, 0.0), (5, 7, 1.0), (5, 7, 1.0)]
    weight = {}
    for a, b, r, w in pairs:
        weight[a, b, r] = max(weight.get((a, b, r), 0), w)
    step = np.zeros((n, n))
    for (a, b, _), w in weight.items():
        step[a, b] += w
    out = step.sum(axis=1)
    df = graph.ppr_push(spark.createDataFrame(seeds, "query_id long, seed long, weight double"), spark.createDataFrame(pairs, "from_id long, to_id long, relation string, weight double"), tolerance=0.004)
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, {})[r.node] = r.score
    assert got.keys() == {1, 2, 3, 5} and got[3] == pytest.approx({999: 1.0}, abs=0.004)
    for q in (1, 2, 5):
        start = np.zeros(n)
        for i, seed, w in seeds:
            start[seed if seed < n else 0] += w if i == q else 0
        start = start / start.sum()
        score = start.copy()
        for _ in range(400):
            flow = np.divide(score, out, out=np.zeros(n), where=out > 0) @ step + score[out == 0].sum() * start
            score = 0.15 * start + 0.85 * flow
        mine = np.array([got[q].get(i, 0.0) for i in range(n)])
        assert np.abs(mine - score).sum() <= 0.004 and (mine <= score + 1e-12).all()


def test_reconciled_symbols_are_the_best_of_all_pairs(spark):
    import random

    rnd = random.Random(4)
    cols = "symbol_id long, repo string, kind string, path string, name string, qualified_name string, signature string, line long, hash string"
    made = lambda first: [(first + i, "r", "K", f"p{rnd.randint(0, 1)}", f"n{rnd.randint(0, 40)}", f"q{rnd.randint(0, 40)}", f"s{rnd.randint(0, 40)}", rnd.randint(0, 3), f"h{rnd.randint(0, 3)}") for i in range(120)]
    old, new = made(0), made(1000)
    want = []
    for n in new:
        met = []
        for o in old:
            p, m, q, s, line, h = (o[i] == n[i] for i in (3, 4, 5, 6, 7, 8))
            if (not p and (s or q or m)) or (p and not (m and q) and (s or line)):
                met.append((100 * s + 80 * q + 50 * m + 40 * h + 20 * line, o[0]))
        best = [x for x in met if x[0] == max(met)[0]]
        want += [(i, n[0], "AMBIGUOUS" if len(best) > 1 else "CANDIDATE", score) for score, i in best]
    found = codegraph.reconcile(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols))
    # pairs are cut to a new symbol's best before the last step, which has no join
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.old_id, r.new_id, r.state, r.score) for r in found.collect()) == sorted(want)


def test_steps_are_dealt_by_the_rows_they_make(spark):
    import random

    rnd = random.Random(5)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(240)}
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "from_id long, to_id long, relation string")
    seeds = spark.createDataFrame([(0,), (7,), (99,)], "seed long")
    want = {}
    for s in (0, 7, 99):
        level, seen = {s}, {s}
        for hop in (1, 2, 3):
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(s, n): hop for n in level}
    for most in (5, 1000):
        got = codegraph.reach(seeds, edges, ["calls"], 3, most=most)
        assert {(r.seed, r.node): r.hops for r in got.collect()} == want


def test_fixpoints_bring_no_table_to_the_driver(spark):
    links = graph.kept_apart(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double"))
    state = graph.kept_apart(spark.createDataFrame([("a", 1, "a"), ("b", 1, "b")], "node string, size long, group string"))
    plan = graph._wishes(state, links, 0.5, 0, "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
