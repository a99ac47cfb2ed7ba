"""Chunks, the positional index and hashed vectors against brute force and hand-made cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserak.functions import text
from tesserak.operators import chunking, lexical, vectors
from tesserak.operators.graph import shared_dir

MANUAL = """Intro line
still intro

# One

```
code

# no heading
```
- a
  b
- c

| x | y |
| 1 | 2 |
para
![f](u)
## Deep

$$
x

y
$$
must do it

#### Skipped

1. first
2) second

# Two
"""


def test_blocks_of_a_manual():
    got = [(kind, path, a, b) for _, _, kind, path, a, b, _ in chunking.spans(MANUAL.strip())]
    assert got == [
        ("DOCUMENT", [], 1, 33),
        ("PARAGRAPH", [], 1, 2),
        ("SECTION", ["One"], 6, 18),
        ("CODE", ["One"], 6, 10),
        ("LIST", ["One"], 11, 13),
        ("TABLE", ["One"], 15, 16),
        ("PARAGRAPH", ["One"], 17, 17),
        ("FIGURE", ["One"], 18, 18),
        ("SECTION", ["One", "Deep"], 21, 27),
        ("EQUATION", ["One", "Deep"], 21, 25),
        ("PARAGRAPH", ["One", "Deep"], 26, 26),
        ("SECTION", ["One", "Deep", "", "Skipped"], 30, 32),
        ("LIST", ["One", "Deep", "", "Skipped"], 30, 31),
    ]


def test_locators_map_back_to_the_text(spark):
    rnd = random.Random(3)
    marks = ["", "", "# ", "- ", "```", "$$", "| a |", "![x](y)", "  in", "\t", "### x ", "2. ", "must "]
    bodies = ["\n".join(rnd.choice(marks) + rnd.choice(["", "w", "two words "]) for _ in range(rnd.randint(0, 40))) for _ in range(80)] + [None, "", " \r\n ", "a\r\nb\rc"]
    df = spark.createDataFrame([(i, f"t{i}", b) for i, b in enumerate(bodies)], "doc_id long, title string, body string")
    units = chunking.structural_units(df).collect()
    for i, b in enumerate(bodies):
        lines = (b or "").replace("\r\n", "\n").replace("\r", "\n").strip().split("\n")
        mine = sorted((u for u in units if u.doc_id == i), key=lambda u: u.structural_order)
        assert [u.structural_order for u in mine] == list(range(len(mine))) and mine[0].unit_type == "DOCUMENT"
        keys = {u.unit_key for u in mine}
        assert len(keys) == len(mine)
        held = [0] * len(lines)
        for u in mine[1:]:
            assert u.parent_key in keys and u.content_hash == hashlib.sha256(u.body.encode()).hexdigest()
            assert "\n".join(lines[u.start_line - 1 : u.end_line]).strip() == u.body
            if not u.container:
                for n in range(u.start_line - 1, u.end_line):
                    held[n] += 1
        # every line with text is in one atom, or is a heading
        for n, line in enumerate(lines):
            assert held[n] <= 1 and (held[n] or not line.strip() or chunking._HEADING.match(line))


def test_context_shows_the_terms():
    section = "lead words. " + "x " * 2000 + "the atom with needle and thread" + " y" * 2000
    shown = chunking.context("the atom with needle and thread", section, ["needle"], 400)
    assert "needle" in shown and len(shown) <= 400 and shown.startswith("…") and shown.endswith("…")
    long = "needle " + "z" * 3000 + " needle thread " + "z" * 3000
    assert "needle thread" in chunking.context(long, None, ["needle", "thread"], 300)
    assert chunking.context(long, None, [], 300) == long[:299].rstrip() + "…"
    assert chunking.context("", "p", ["a"], 10) == "" and chunking.context("ab", "ab", ["a"], 10) == "ab"
    assert chunking.best_window("a b", ["q"], 2) == "a…"


def slow_density(words, terms, weights):
    """Cover density by trying every stretch."""
    at = [i for i, w in enumerate(words) if w in terms]
    least = [(p, q) for p in at for q in at if p <= q and {words[i] for i in at if p <= i <= q} == terms]
    least = [(p, q) for p, q in least if not any((a, b) != (p, q) and p <= a and b <= q for a, b in least)]
    out = 0.0
    for p, q in least:
        inside = [i for i in at if p <= i <= q]
        out += len(inside) / sum(1 / weights[i] for i in inside) / (1 + (q - p) - (len(inside) - 1))
    return out


def test_cover_density_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        n, m = rnd.randint(1, 40), rnd.randint(1, 4)
        words = [rnd.choice("abcdefgh"[: m + 3]) for _ in range(n)]
        terms = set("abcd"[:m])
        if not terms <= set(words):
            continue
        classes = [rnd.randint(0, 3) for _ in range(n)]
        weights = [lexical.CLASS_WEIGHT[lexical.CLASSES[c]] for c in classes]
        places = [np.array([4 * (i + 1) + classes[i] for i in range(n) if words[i] == t]) for t in sorted(terms)]
        assert lexical.cover_density(places) == pytest.approx(slow_density(words, terms, weights))
    assert lexical.cover_density([np.array([4]), np.array([8])]) == pytest.approx(0.1)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "fooBar", "ñandú", "eps"]
    rows = []
    for i in range(120):
        body = "\n\n".join(rnd.choice(["", "# ", "- "]) + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 5)))
        rows.append((i, f"X-{i}", [f"al {rnd.choice(words)}"], rnd.choice(words) + " title", f"p/{rnd.choice(words)}/{i}.md", body))
    rows.append((500, None, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, external_id string, aliases array<string>, title string, path string, body string")
    units = chunking.structural_units(docs)
    return docs, units, lexical.Index(f"{shared_dir(spark)}/index-test", 8).write(docs, units)


def by_hand(spark, docs, units, query):
    """(doc_id -> score, reason) by whole scans."""
    split = lambda df, cols: df.select("doc_id", *[c for c in ("structural_order", "container") if c in df.columns], *[text.tokens(F.coalesce(c, F.lit(""))).alias(n) for n, c in cols.items()], *[text.tokens(text.symbol_text(F.coalesce(c, F.lit("")))).alias("s_" + n) for n, c in cols.items()]).collect()
    own = split(docs, {"external_id": F.col("external_id"), "alias": F.concat_ws(" ", "aliases"), "title": F.col("title"), "path": F.col("path"), "body": F.col("body")})
    inner = split(units, {"heading": F.array_join("heading_path", " "), "unit": F.concat_ws(" ", "unit_key", "unit_type"), "text": F.col("body")})
    one = spark.createDataFrame([(query,)], "q string").select(text.tokens(F.col("q")).alias("t"), text.tokens(text.symbol_text(F.col("q"))).alias("s")).first()
    terms, named = set(one.t), set(one.s)
    out = {}

    def parts(r, fields):
        rank = {f: slow_density(r[f], terms, [0.1] * len(r[f])) for f in fields if terms and terms <= set(r[f])}
        plain = bool(terms) and terms <= {w for f in fields for w in r[f]}
        flat = [(w, lexical.CLASS_WEIGHT[lexical.SYMBOL_CLASS[f]]) for f in fields for w in r["s_" + f]]
        symbol = slow_density([w for w, _ in flat], named, [x for _, x in flat]) if named and named <= {w for w, _ in flat} else None
        return rank, plain, symbol

    for r in own:
        rank, plain, symbol = parts(r, lexical.DOCUMENT)
        best, met = None, plain or symbol is not None
        for u in (u for u in inner if u.doc_id == r.doc_id):
            urank, uplain, usymbol = parts(u, lexical.UNIT)
            if u.structural_order == 0:
                usymbol = None
                uplain = bool(terms) and terms <= set(r["title"]) | set(r["body"])
                urank = {n: rank[f] for n, f in (("heading", "title"), ("text", "body")) if f in rank}
            met |= uplain or usymbol is not None
            score = sum(w * urank.get(f, 0) for f, w in lexical.UNIT.items()) + (0 if uplain else 10 * (usymbol or 0))
            key = (-round(score, 9), u.container, u.structural_order)
            if score > 0 and (best is None or key < best[0]):
                best = (key, score, urank, usymbol)
        if met:
            score = sum(w * rank.get(f, 0) for f, w in lexical.DOCUMENT.items()) + (0 if plain else 26 * (symbol or 0)) + (best[1] if best else 0)
            checks = [*((f in rank, f) for f in ("external_id", "alias", "path", "title")), (symbol is not None and not plain, "symbol")]
            checks += [("heading" in best[2], "heading"), ("unit" in best[2], "unit"), (best[3] is not None, "symbol")] if best else []
            out[r.doc_id] = (round(score, 6), lexical.REASONS[next((f for ok, f in checks if ok), "body")])
    return out


def test_search_matches_brute_force(spark, corpus):
    docs, units, index = corpus
    asked = ["alpha", "alpha beta", "beta alpha alpha gamma", "foo bar", "fooBar", "X-7", "title gamma", "ñandú eps", "absent", "", "paragraph", "list gamma", "al delta"]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in lexical.search(index, df, docs, 1000).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = (r.raw_score, r.reason)
    for i, q in enumerate(asked):
        want = by_hand(spark, docs, units, q)
        mine = got.get(i, {})
        assert mine.keys() == want.keys(), q
        for d, (score, reason) in want.items():
            assert mine[d][0] == pytest.approx(score, abs=2e-6) and mine[d][1] == reason, (q, d)
    few = {}
    for r in lexical.search(index, df, docs.where("doc_id % 2 = 0"), 5).orderBy("query_id", F.desc("raw_score"), "doc_id").collect():
        few.setdefault(r.query_id, []).append((r.raw_score, r.doc_id))
    for i in range(len(asked)):
        want = sorted(((-s, d) for d, (s, _) in got.get(i, {}).items() if d % 2 == 0))[:5]
        assert few.get(i, []) == [(-s, d) for s, d in want]


def test_more_terms_than_lead_to_candidates(spark, corpus):
    docs, units, index = corpus
    asked = ["alpha beta gamma delta eps title", "fooBar alpha eps delta gamma beta", "title x p md al"]
    got = {}
    for r in lexical.search(index, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), docs, 1000).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = (r.raw_score, r.reason)
    for i, q in enumerate(asked):
        want = by_hand(spark, docs, units, q)
        mine = got.get(i, {})
        assert want and mine.keys() == want.keys(), q
        assert all(mine[d][0] == pytest.approx(s, abs=2e-6) and mine[d][1] == why for d, (s, why) in want.items())


def test_an_index_is_not_much_larger_than_its_texts(spark):
    rnd = random.Random(5)
    known = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    bodies = ["\n\n".join(f"# {rnd.choice(known)}\n" + " ".join(rnd.choice(known) for _ in range(150)) for _ in range(4)) for _ in range(200)]
    docs = spark.createDataFrame([(i, f"X-{i}", [f"a{i}"], "t", f"p/{i}", b) for i, b in enumerate(bodies)], "doc_id long, external_id string, aliases array<string>, title string, path string, body string")
    index = lexical.Index(f"{shared_dir(spark)}/small-index", 4).write(docs, chunking.structural_units(docs))
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{index.path}/postings").agg(F.sum("length")).first()[0]
    assert size < 1.2 * sum(map(len, bodies))


def test_an_index_is_written_without_a_shuffle(spark, corpus):
    docs, _, index = corpus
    docs = docs.repartition(3).localCheckpoint()
    names = spark.read.parquet(f"{index.path}/units").where("unit > 0")
    rows = lexical.packed(docs, names, 8)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    again = lexical.Index(f"{shared_dir(spark)}/unshuffled", 8).write(docs)
    held = lambda i: sorted(map(tuple, i.terms(spark, rows.select("term")).collect()))
    assert held(again) == held(index)


def test_lines_are_counted_before_the_last_unit_only(spark):
    docs = spark.createDataFrame([(1, "t", "a b\n\n# H\nc d\n\nlast"), (2, "t", "one\ntwo")], "doc_id long, title string, body string")
    counted = spark.sparkContext.accumulator(0)

    def count(line):
        counted.add(1)
        return len(line.split())

    got = chunking.structural_units(docs, count).select("doc_id", "structural_order", "before").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 1, 0), (1, 2, 4), (1, 3, 4), (1, 4, 6), (2, 0, 0), (2, 1, 0)]
    assert counted.value == 5


def test_plain_text_tells_which_types_are_likely(spark):
    assert chunking.literals("COUNTEREXAMPLE") == ["counterexample", "contraejemplo", "anti-pattern", "antipatr"]
    bodies = ["an antipatrón!", "antipatrones", "dado que x", "a cita b", "cita", "citation", "must not", "plain words", "given"]
    docs = spark.createDataFrame([(i, "t", b) for i, b in enumerate(bodies)], "doc_id long, title string, body string")
    got = {r.doc_id: r.unit_type for r in chunking.structural_units(docs).where("not container").collect()}
    for i, body in enumerate(bodies):
        want = next((k for k in chunking.MEANINGS if re.search(chunking.meaning(k), "t " + body)), "PARAGRAPH")
        assert got[i] == want, body


def test_small_numbers_come_back():
    values = np.array([0, 1, -1, 63, -64, 64, 2**31, -(2**31), 2**62, -(2**62), 2**63 - 1, -(2**63)])
    data, ends = lexical.varints(values)
    back, again = lexical.from_varints(data)
    assert back.tolist() == values.tolist() and ends.tolist() == again.tolist()


def test_queries_read_their_terms_folders_only(spark, corpus):
    _, _, index = corpus
    read = index.read(spark, spark.createDataFrame([("alpha",)], "term string"))
    assert {f.split("bucket=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {str(spark.createDataFrame([("alpha",)], "term string").select(index.bucket(F.col("term"))).first()[0])}


def test_a_sieve_leaves_out_most_of_what_is_not_wanted(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"E-{i}", [f"a{i}"], "Title", f"p/{i}.md", "# Head\n\n" + " ".join(rng.choices([f"w{j}" for j in range(40)] + ["été"], k=60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, external_id string, aliases array<string>, title string, path string, body string")
    index = lexical.Index(str(tmp_path / "index"), 4).write(docs)
    asked = spark.createDataFrame([(f"w{j}",) for j in range(40)] + [("été",), ("t",)], "term string")
    every = {(r.term, r.doc_id): r for r in index.spots(spark, asked).collect()}
    wanted = set(rng.sample(sorted(every), 300))
    held = lexical.sieve(spark.createDataFrame(sorted(wanted), "term string, doc_id long"))
    got = {(r.term, r.doc_id): r for r in index.spots(spark, asked, held).collect()}
    assert wanted <= got.keys() and len(got) < len(wanted) + len(every) / 50
    assert all(every[k] == r for k, r in got.items())
    homes = index.spots(spark, asked).mapInArrow(lexical._homes, "term string, doc_id long, unit int, symbol boolean")
    posted = lexical.postings(index.spots(spark, asked)).select("term", "doc_id", "unit", "symbol").distinct()
    assert sorted(map(tuple, homes.collect())) == sorted(map(tuple, posted.collect()))


def test_a_search_takes_few_places_out_of_tasks(spark, tmp_path, monkeypatch):
    """Every query asks for a word of its own and common ones: of the common words'
    places only those in its own documents may go on, without a table sent to all tasks."""
    body = lambda i: " ".join([f"own{i}", *(f"common{j}" for j in range(i % 50, i % 50 + 20))])
    rows = [(i, f"E-{i}", [f"a{i}"], "Title", f"p/{i}.md", body(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, external_id string, aliases array<string>, title string, path string, body string")
    index, seen, made = lexical.Index(str(tmp_path / "index"), 4).write(docs), [], lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda spots: seen.append(spots.count()) or made(spots))
    queries = spark.createDataFrame([(i, f"own{i} common{i % 50 + 3}") for i in range(0, 300, 3)], "query_id long, query string")
    got = lexical.search(index, queries, docs.select("doc_id"), 5).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(0, 300, 3)]
    assert max(seen) < 300  # 200 are wanted


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "Él niño_x a-b niño_x"), (2, ""), (3, None), (4, "zz")], "id long, text string")
    got = {r.id: r.embedding for r in vectors.embedded(df, 16).collect()}
    want = [0] * 16
    for w in ("el", "nino_x", "a-b", "nino_x"):
        h = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(h[:2]) % 16] += 1 if h[2] % 2 == 0 else -1
    assert got.keys() == {1, 4} and got[1] == want


def test_top_k_in_blocks_and_by_best_row(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 8)), rng.normal(size=(30, 8))
    v = spark.createDataFrame([(i % 150, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    for most in (64 << 20, 500):
        got = vectors.topk_batch(v, asked, 7, most).toPandas()
        for i in range(30):
            best = {j: max(round(cos[i, r], 9) for r in range(j, 400, 150)) for j in range(150)}
            want = sorted(best, key=lambda j: (-best[j], j))[:7]
            assert got[got.query_id == i].sort_values("rank").vec_id.tolist() == want


@pytest.mark.parametrize(("per", "part"), [(1024, 4096), (20, 4096), (7, 11)])
@pytest.mark.parametrize("least", [0.3, 0.9, 0.999])
def test_near_pairs_are_exact(spark, per, part, least):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(120, 16)), np.repeat(rng.normal(size=(6, 16)), 15, axis=0) + rng.normal(scale=0.15, size=(90, 16)), np.repeat(rng.normal(size=(1, 16)), 30, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True)}
    got = vectors.near_duplicate_pairs(df, least, per_pivot=per, part=part).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert vectors.near_duplicate_pairs(df.where("vec_id > 899"), least).count() == 0


def test_clustered_vectors_meet_few_homes(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 32))
    x = np.repeat(centre, 50, axis=0) + rng.normal(scale=0.1, size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    pivots = [r.vec_id for r in df.select("vec_id", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(200).collect()]
    angle = np.arccos(np.clip(u @ u[pivots].T, -1, 1))
    home = angle.argmin(axis=1)
    radius = np.array([angle[home == i, i].max(initial=-np.inf) for i in range(200)])
    near = (angle <= radius + np.arccos(0.9)) & (np.arange(200) >= home[:, None])
    compared = sum(int(near[:, i].sum()) * int((home == i).sum()) for i in range(200))
    assert compared < 0.05 * len(x) ** 2 / 2
    got = {(r.a, r.b) for r in vectors.near_duplicate_pairs(df, 0.9, per_pivot=10).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)}


@pytest.mark.parametrize("part, turn", [(50, 40), (400, 100), (5000, 1000)])
def test_pairs_are_scored_where_they_are_found(spark, part, turn):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[500:] = x[0]  # one home of copies, larger than a cell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = vectors.near_duplicate_pairs(df, 0.35, per_pivot=60, part=part, turn=turn)
    # no pair carries vectors through a join, and a task's visitors are bounded
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    named = lambda side: df.select(F.col("vec_id").alias(side), F.col("embedding").alias("v_" + side))
    score = vectors.cosine(F.col("v_a"), F.col("v_b"))
    want = named("a").join(named("b"), F.col("a") < F.col("b")).where(score >= 0.35).select("a", "b", F.round(score, 6).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_joins_with_labels_move_no_texts(spark, monkeypatch, capsys):
    """Where labels are too many to be broadcast, as at 1 GB, a join with them shuffles what it holds."""
    import oracle

    from tesserak.plans import answers, retrieval
    from tesserak.sources import bind

    def shuffled(df):
        """The columns that each shuffle of a plan takes."""
        df.explain("formatted")
        return re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d, seen = oracle.sf("sf0.001"), []
        monkeypatch.setattr(retrieval, "stored", lambda spark, d, name, write: write(name) or name)
        monkeypatch.setattr(lexical.Index, "write", lambda self, docs: seen.append(docs))
        retrieval.lexical_index(spark, d)
        assert not shuffled(seen[0].select("doc_id", "external_id", "aliases", "title", "path", "body"))
        taken = shuffled(retrieval.governed(spark, d).select("doc_id", "title", "digest"))
        assert taken and not any("text#" in x for x in taken)
        assert bind.documents(spark, d).select("doc_id", F.sha2("body", 256).alias("digest")).exceptAll(bind.identified(spark, d).select("doc_id", "digest")).isEmpty()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)  # hits are few
        hits = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "query_id long, doc_id long")
        few = bind.documents(spark, d, among=answers._met(hits))
        assert [r.doc_id for r in few.select("doc_id").orderBy("doc_id").collect()] == [2, 3]
        assert {r.doc_id for r in bind.structural(spark, d, among=answers._met(hits)).collect()} == {2, 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
