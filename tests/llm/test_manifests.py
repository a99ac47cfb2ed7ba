"""Manifest, shards and fill-in-middle against brute force, with odd rows in every input."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tesserak.llm import fim, merkle, sharding
from tesserak.llm.shared import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def made(n=150, seed=5):
    rnd = random.Random(seed)
    words = ["ab", "é", "ñandú", "\n", "x\n\ny", "𝔘", " ", "<P", "M>", "\r\n"]
    rows = [(rnd.randint(-5, 120), "".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None, "zz"]), rnd.choice(["s", None, ""]), rnd.choice([None, 3, 40])) for _ in range(n)]
    long = "\n".join("é" * rnd.randint(0, 90) for _ in range(60))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 0), (None, "a\nb", "en", None, None), (None, "a\nb", "en", None, None), (502, long, "de", "s", 9), (502, long, "de", "s", 9), (None, long + "\n", "fr", "s", 9), (503, "y" * 5000, "fr", "s", 1), (504, "has <P> inside\n" * 40, "en", "s", 2), (505, "\n" * 700, "en", "s", 3), (506, "one", "only", "s", 3)]
    return rows + rows[:7] + [(600 + i, "copy\nof\nall", "en", "s", 11) for i in range(90)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("n", "form", "size", "shard", "at", "tree", "leaf", "claim", "digest", "slot", "of"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def forest(rows, k):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row, by the rules."""

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // k * k : i // k * k + k]
            out.append((i % k, [x for j, x in enumerate(run) if j != i % k]))
            i //= k
        return out

    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = H(*map(framed, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        claim = H(*map(framed, (doc_id, source, lang, n + 1, text))) if hit else leaf
        groups.setdefault(lang, []).append((doc_id is not None, doc_id, leaf, claim))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[lang] = up([r[2] for r in groups[lang]])
    top = up([trees[x][-1][0] for x in order])
    out = []
    for j, lang in enumerate(order):
        for i, (_, doc_id, leaf, claim) in enumerate(groups[lang]):
            path, node = way(trees[lang], i) + way(top, j), claim
            for place, others in path:
                node = H(*others[:place], node, *others[place:])
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], H(*(x for _, o in path for x in o)), node, node == top[-1][0]))
    return out


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize(("fan_out", "depth"), [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest_matches_brute_force(docs, rows, fan_out, depth):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = merkle.leaves(docs, changes={"n_chars": docs.n_chars + 1}, where=hit)
    got = merkle.manifest(leaves, merkle.Shape(fan_out, depth)).proofs(with_path=True).collect()
    want = forest(rows, fan_out)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert {r.verified for r in got} == {True, False}
    for r in got:
        assert merkle.fold(r.leaf, r.path) == r.root


def test_manifest_levels_are_stored(docs, rows):
    m = merkle.manifest(merkle.leaves(docs), merkle.Shape(2, 3))
    n = sum(r[2] == "en" for r in rows)
    held = {r.level: r["count"] for r in m.trees.levels(0, 99).where("tree = '+en'").groupBy("level").count().collect()}
    want, level = {}, 0
    while True:
        want[level] = n
        if n == 1:
            break
        n, level = -(-n // 2), level + 1
    assert held == want


def test_manifest_of_one_row_and_none(spark):
    one = merkle.manifest(merkle.leaves(spark.createDataFrame([(1, None, None, None, None)], SCHEMA))).proofs().collect()
    assert [tuple(r)[1:] for r in one] == [(x := H("1:1", "-", "-", "-", "-"), x, x, H(), x, True)]
    assert merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA))).proofs().count() == 0


def test_numbers_are_gapless(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("s"), (F.col("id") % 50).alias("o"))
    got = numbered(df, "s", ["o"], "place").toPandas()
    for _, g in got.groupby("s"):
        g = g.sort_values("place")
        assert g.place.tolist() == list(range(len(g))) and g.o.is_monotonic_increasing and (g["of"] == len(g)).all()


def minimax(sizes, k):
    """The least possible greatest sum of k runs, by dynamic programming."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [min(max(best[m], sums[i] - sums[m]) for m in range(i + 1)) for i in range(len(sums))]
    return best[-1]


@pytest.mark.parametrize("shards", [1, 2, 5, 24, 400])
def test_shards_match_brute_force(docs, rows, shards):
    got = sharding.by_bytes(docs, shards).toPandas()
    want = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows]
    none = lambda x: None if x != x or x is None else int(x)
    assert sorted(((none(a), int(b), int(c)) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)), key=key) == sorted(want, key=key)
    assert (got.groupby("text_crc32").shard.nunique() == 1).all() and got.shard.between(0, shards - 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    groups = {}
    for _, t, *_ in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    order = sorted(groups, key=lambda t: H(t))
    alone, left = [], sum(groups.values())
    for t in sorted(groups, key=lambda t: (-groups[t], H(t))):
        if len(alone) == shards - 1 or groups[t] * (shards - len(alone)) <= left:
            break
        alone.append(t)
        left -= groups[t]
    rest = [groups[t] for t in order if t not in alone]
    least = max([minimax(rest, shards - len(alone)), *(groups[t] for t in alone)])
    assert got.groupby("shard")["size"].sum().max() == least
    # runs follow the order of the digests
    shard_of = dict(zip(got.text_crc32, got.shard, strict=True))
    runs = [shard_of[zlib.crc32(t.encode())] for t in order if t not in alone]
    assert runs == sorted(runs)


def test_shards_refine_only_where_a_cut_may_fall():
    rnd = random.Random(4)
    groups = sorted((H(str(i)), rnd.randint(9, 90)) for i in range(30_000))

    def blocks(prefixes, digits):
        out = {}
        for d, s in groups:
            if prefixes is None or d[: digits - 1] in prefixes:
                a, n = out.get(d[:digits], (0, 0))
                out[d[:digits]] = (a + s, n + 1)
        return [sharding.Block(p, a, n) for p, (a, n) in out.items()]

    digits, order, read = sharding.FIRST, sharding.Order(blocks(None, sharding.FIRST)), 0
    while True:
        low, high = order.bounds(24)
        if low == high:
            break
        gone = {b.prefix for b in order.open_blocks(24, low, high)}
        assert all(len(p) == digits for p in gone) and len(gone) < 1500
        digits += 1
        finer = blocks(gone, digits)
        read += len(finer)
        order = sharding.Order([b for b in order.blocks if b.prefix not in gone] + finer)
    sums = [0]
    for _, s in groups:
        sums.append(sums[-1] + s)

    def fits(c):
        at, i = 0, 0
        for _ in range(24):
            while i < len(groups) and sums[i + 1] - at <= c:
                i += 1
            at = sums[i]
        return i == len(groups)

    assert fits(high) and not fits(high - 1) and read < len(groups)
    begins = order.cuts(24, high)
    held = [0] * 24
    for d, s in groups:
        held[sum(d >= b for b in begins)] += s
    assert max(held) <= high and min(held) > 0.99 * sums[-1] / 24


def test_shards_of_an_empty_table(spark):
    assert sharding.by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = H("7:", "" if doc_id is None else str(doc_id))
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, H(text), H(text)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), H(out), H(text)


@pytest.mark.parametrize("chunk", [1 << 16, 64, 7, 1])
def test_fill_in_middle_matches_brute_force(docs, rows, chunk):
    got = [tuple(r) for r in fim.digests(docs, fim.Settings(chunk=chunk)).collect()]
    assert sorted(got, key=key) == sorted((by_hand(r[0], r[1]) for r in rows), key=key)


def test_fill_in_middle_of_a_very_long_text(spark):
    text = "".join("ü" * (i % 400) + "\n" for i in range(40_000)) + "end"
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    assert sorted(tuple(r) for r in fim.digests(df).collect()) == [by_hand(i, text) for i in range(4)]
    assert fim.digests(df.where("false")).count() == 0


def test_forms_follow_the_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = {r.form: r["count"] for r in fim.transform(df, fim.Settings(transformed=60, suffix_first=25)).groupBy("form").count().collect()}
    assert 120 < forms["plain"] < 200 and 35 < forms["spm"] < 90
