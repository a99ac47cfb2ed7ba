"""Operators on documents against brute force, with odd rows in every input."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserak.llm import bpe, langid, licenses, minhash, packing, substring, toxicity, unigram
from tesserak.llm.queries import BPE_FILE, PIECE_FILE

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=60, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 160))) for _ in range(n)]
    out += [" ".join(w if rnd.random() > 0.03 else "zz" for w in out[i].split(" ")) for i in range(0, 30)]
    out += [out[0], out[0], out[1] + "\n" + out[2], "", None, "   \n\t ", "one", "one", "Ünï  \r\n x<|endoftext|>y", "Z" * 3000, (out[3] + " ") * 60]
    return out


@pytest.fixture(scope="module")
def texts():
    return made()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE_FILE)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing_is_whole(docs, texts, tokenizer):
    rows = packing.pack_texts(docs, BPE_FILE, with_ids=True).toPandas()
    for i, t in enumerate(texts):
        want = np.array(ids_of(tokenizer, t) + [1], dtype="<u4")
        mine = rows[rows.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == want.tobytes() and set(mine.doc_tokens) == {len(want)}
        assert all(zlib.crc32(x) == c for x, c in zip(mine.ids, mine.ids_crc32, strict=True))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        total = int(s.length.sum())
        assert total == 2048 or total & (total - 1) == 0


def test_packing_limits_together(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        n = rnd.randint(1, 90)
        rows.append((i, list(range(n)), [rnd.random() < 0.4 for _ in range(n)] if i % 3 else None))
    df = spark.createDataFrame(rows + [(900, [], None), (901, None, None)], "doc_id long, ids array<int>, bears array<boolean>")
    got = packing.pack_examples(df, packing.Limits(tokens=64, segments=5, loss=40, waiting=32)).toPandas()
    per = got.groupby("sequence_id").agg(tokens=("length", "sum"), n=("length", "size"), loss=("loss_tokens", "sum"))
    assert per.tokens.max() <= 64 and per.n.max() <= 5 and per.loss.max() <= 40
    assert got.length.sum() == sum(len(r[1]) for r in rows)
    assert got.loss_tokens.sum() == sum(sum(r[2]) if r[2] is not None else len(r[1]) for r in rows)


def brute_components(texts, k, share):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("words,pairs", [(2, 48), (2, 1), (5, 48)])
def test_minhash_finds_all_links(docs, texts, words, pairs):
    sets, want = brute_components(texts, words, 80)
    got = minhash.near_duplicates(docs, minhash.Settings(words=words, pairs=pairs, group=8)).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    assert [got.component_id[i] for i in range(len(texts))] == want
    assert [got.n_shingles[i] for i in range(len(texts))] == [len(sets[i]) for i in range(len(texts))]
    assert all(got.kept[i] == (want[i] == i) for i in range(len(texts)))


def test_sketch_is_full_and_close():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 3, dtype=np.int64).view(np.uint64)
    one = minhash.sketches(np.zeros(3, np.int64), a, 1, 128)
    assert (one < np.iinfo(np.uint64).max).all()
    x = rng.integers(0, 1 << 62, 1000, dtype=np.int64).view(np.uint64)
    y = x.copy()
    y[:200] = rng.integers(0, 1 << 62, 200, dtype=np.int64).view(np.uint64)
    both = minhash.sketches(np.repeat([0, 1], 1000), np.concatenate((x, y)), 2, 128)
    assert (both[0] == both[1]).mean() == pytest.approx(800 / 1200, abs=0.15)


def test_substring_matches_brute_force(spark):
    texts = made(40, 9)
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [f"{i} {shared} {i} tail" for i in range(8)] + [shared[:200]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = substring.brute_force(dict(enumerate(texts)), 50)
    got = substring.digests(df).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        left = [w for w, k in zip(words, want[i], strict=True) if k]
        assert got.n_words[i] == len(words) and got.n_removed[i] == len(words) - len(left), i
        assert got.kept_sha256[i] == hashlib.sha256(b" ".join(left)).hexdigest()
    cut = substring.remove_repeats(df).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        left = [w for w, k in zip((t or "").encode().split(), want[i], strict=True) if k]
        assert (cut.text[i] or "").encode().split() == left


def test_substring_with_ids_that_stand_with_two_texts(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, word("a", 980)), (7, word("a", 980)), (7, word("b", 60)), (8, word("b", 60)), (9, word("c", 70)), (9, word("c", 70)), (10, "x " + word("c", 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("body", F.lit("clash"))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.digests(df).collect())
    assert got == [(1, 980, 0), (7, 60, 0), (7, 980, 980), (8, 60, 60), (9, 70, 0), (9, 70, 0), (10, 61, 60)]
    assert {r.text for r in substring.remove_repeats(df).where("doc_id = 7").collect()} == {"", rows[2][1]}


def test_sketch_never_counts_too_few(spark):
    rnd = random.Random(12)
    anchors = [rnd.getrandbits(63) - (1 << 62) for _ in range(300)]
    lists = [rnd.sample(anchors, rnd.randint(0, 40)) for _ in range(80)]
    held = {a: sum(a in x for x in lists) for a in anchors}
    s = substring.Settings(block=64, partial=50)
    df = spark.createDataFrame([(i, 0, [*x, *x[:2]]) for i, x in enumerate(lists)], "doc_id long, body long, anchors array<long>").repartition(4)
    full = {(r.row, r.cell): r.n for r in substring.merged_sketch(substring.partial_sketches(df, 12, s), s).collect()}
    rows = substring.cells_of(np.array(anchors), 12)
    for i, a in enumerate(anchors):
        estimate = min(full.get((row, int(rows[row][i])), 1) for row in (0, 1))
        assert estimate >= held[a] or held[a] < 2
    kept = {(r.doc_id, r.anchor) for r in substring.repeated_anchors(df, s).collect()}
    assert kept >= {(i, a) for i, x in enumerate(lists) for a in x if held[a] > 1}
    both = spark.createDataFrame([(a,) for a in anchors], "anchor long").select("anchor", substring._cell(0, 40).alias("x"), substring._cell(1, 40).alias("y")).collect()
    rows = substring.cells_of(np.array([r.anchor for r in both]), 40)
    assert [r.x for r in both] == rows[0].tolist() and [r.y for r in both] == rows[1].tolist()


def test_token_counts_match_the_tokenizer(docs, texts):
    from tokenizers import Tokenizer, models

    vocabulary = unigram.sentencepiece_vocabulary(PIECE_FILE)
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in unigram.count_tokens(docs, vocabulary).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got[i] == (len(words), sum(len(model.encode(unigram.MARK + w).ids) for w in words))


def test_token_counts_of_odd_rows(spark):
    vocabulary = unigram.sentencepiece_vocabulary(PIECE_FILE)
    assert sum(math.exp(x) for _, x in vocabulary[1:]) == pytest.approx(1)
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, "ab" * 300_000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in unigram.count_tokens(df, vocabulary).collect()))
    assert [x[:2] for x in got] == [(0, 2), (1, 2), (1, 2), (2, 1), (3, 0)] and got[0][2] == got[1][2] and 100_000 < got[3][2] <= 300_001


def test_token_counts_are_near_a_real_tokenizer(texts):
    from sentencepiece import SentencePieceProcessor

    sp, counter = SentencePieceProcessor(model_file=PIECE_FILE), unigram.PieceCounter(unigram.sentencepiece_vocabulary(PIECE_FILE))
    words = "the quick brown fox jumps over a lazy dog information retrieval statistics newspaper economic development government".split()
    words += sorted({w for t in texts for w in (t or "").split() if len(w) < 100})
    mine, real = sum(counter.count(unigram.MARK + w) for w in words), sum(len(sp.encode(w)) for w in words)
    assert abs(mine - real) < 0.05 * real


def test_unigram_ties():
    from tokenizers import Tokenizer, models

    rnd = random.Random(2)
    for _ in range(80):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))) for _ in range(8)}
        vocabulary = [("<unk>", 0.0), *((p, -float(rnd.randint(1, 3))) for p in sorted(pieces))]
        model, mine = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False)), unigram.PieceCounter(vocabulary)
        for _ in range(15):
            word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))
            assert mine.count(word) == len(model.encode(word).ids)


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    texts = ["Under the MIT license; under the mit LICENSE.", "x\n(CC-BY-NC) cc by nc", "licensed under the Apache License, Version 2.0", None, "", "under the mit", filler + " This work is licensed under the GNU General Public License " + filler, "permission is hereby granted, free of charge, to any person obtaining a copy of this thing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "gpl" in got[6].labels and got[7].labels == "mit"


@pytest.mark.parametrize("width", [25, 72, 10_000])
def test_wrapped_notices(spark, width):
    import textwrap

    long = " ".join(f"t{i}" for i in range(50))
    s = licenses.Settings(templates=(*licenses.TEMPLATES, ("long", long)))
    rows, want = [], []
    for label, text in s.templates:
        for before in range(0, 130, 7):
            words = " ".join([f"w{i}" for i in range(before)] + [text] + [f"v{i}" for i in range(150)])
            rows.append((len(rows), textwrap.fill(words, width, initial_indent="# ", subsequent_indent="# ")))
            want.append(label)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, s).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1 for i, label in enumerate(want))


def test_set_join_misses_no_block():
    rnd = random.Random(5)
    tokens = [f"t{i}" for i in range(30)]
    s = licenses.Settings(share=0.7, templates=tuple((f"l{i}", " ".join(rnd.sample(tokens, rnd.randint(1, 9)))) for i in range(25)))
    join = licenses.Join(s, {t.encode(): rnd.randint(0, 5) for t in tokens})
    for _ in range(300):
        block = [rnd.choice(tokens).encode() for _ in range(rnd.randint(1, 25))]
        want = {}
        for label, text in s.templates:
            wanted = set(licenses.words_of(text))
            if len(wanted & set(block)) >= math.ceil(s.share * len(wanted) - 1e-9):
                want[label] = len(wanted & set(block)) / len(wanted)
        assert join.matches(block) == pytest.approx(want)


def test_language(spark):
    rnd = random.Random(8)
    words = {"en": ["the", "this", "thing", "with", "water"], "fr": ["eau", "oui", "les", "que", "où"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["en", "fr"] * 60)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "fr"), (None, "the thing", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).toPandas()
    assert len(got) == 124 and got.score.between(0, 1).all()
    named = got[got.doc_id < 1000]
    assert (named.lang == named.lang_pred).mean() > 0.95
    assert set(got[got.doc_id >= 1000].lang_pred) == {"und"}
    none = langid.fit(df.where("false"))
    assert set(langid.identify(df, none).toPandas().lang_pred) == {"und"}


def slow_profile(texts, ranks):
    """n-grams of one to three letters by count, then by their order in langid."""
    from collections import Counter

    n = Counter()
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in (t or "").lower() + " ")
        s = re.sub(" +", " ", s)
        n.update(c for c in s if c != " ")
        n.update(s[i : i + 2] for i in range(len(s) - 1))
        n.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    order = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], order(g)))[:ranks])}


def test_distances_match_brute_force(spark):
    rnd = random.Random(21)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmnoé"}
    make = lambda k: " ".join("".join(rnd.choice(letters[k]) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 40)))
    rows = [(i, make(k), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    s = langid.Settings(ranks=60)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    profiles = {k: slow_profile([t for _, t, x in learned if x == k], 60) for k in letters}
    for r in langid.identify(df.withColumn("distance", F.lit("clash")), langid.fit(df, s)).collect():
        own = slow_profile([r.text], 60)
        total = {k: sum(abs(p[g] - i) if g in p else 60 for g, i in own.items()) for k, p in profiles.items()}
        near = sorted((v, k) for k, v in total.items())
        assert r.lang_pred == near[0][1] and r.distance == pytest.approx(near[0][0] / (60 * len(own)))
        assert r.score == pytest.approx(1 - near[0][0] / near[1][0])


def test_letters_beyond_the_first_plane(spark):
    rows = [(i, "\U00010330\U00010331\U00010332 \U00010333" if i % 2 else "plain words here", "got" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame([*rows, (99, "\U00020000\U00020001", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
    assert all(got[i] == k for i, _, k in rows) and got[99] != "und"
    assert langid.identify(df.where("false"), langid.fit(df)).count() == 0


def test_profiles_count_all_texts(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(3)), "x") for i in range(3000)]
    learned = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n = Counter()
    for _, gram, _, count in zip(*(x.tolist() for x in langid.ranked(learned, 1 << 30)), strict=True):
        n[gram] += count
    best = sorted(n, key=lambda g: (-n[g], g))[:300]
    profiles = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.grams.tolist() == sorted(best)
    assert profiles.ranks[:, 0].tolist() == [best.index(g) for g in sorted(best)]


def test_unusual_texts(spark):
    rnd = random.Random(31)
    words = ["water", "the", "thing", "other", "with", "house", "again", "under"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)), "en") for i in range(400)]
    odd = [(1000 + i, " ".join("".join(rnd.choice("бвгджзклмн") for _ in range(6)) for _ in range(60)), "en") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df.union(spark.createDataFrame([*odd, (2000, None, "en"), (None, rows[0][1], None)], df.schema)), langid.fit(df)).collect()
    assert {r.doc_id for r in got if not r.usual} == {1000, 1001, 1002, 2000} and len(got) == 405


def test_toxicity_scores_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.Model(-0.3, rng.normal(size=16), rng.normal(size=(16, 3)), (rng.random(16) < 0.7).astype(float))
    rows = [[1, 5, 9], [], [2], list(range(16))]
    for row, got in zip(rows, model.scores(rows), strict=True):
        x = model.scale[row]
        total = model.bias + float(model.weight[row] @ x)
        for i in range(len(row)):
            for j in range(i):
                total += float(model.factor[row[i]] @ model.factor[row[j]]) * x[i] * x[j]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def slow_packer(sizes, limits):
    """The dot-product rule over (key, size), all waiting at once: (key, start, length, sequence, offset)."""
    waiting, out, sequence = [(k, 0, n) for k, n in sizes], [], 0
    while waiting:
        left = sum(n for _, _, n in waiting)
        room = tokens = min(limits.tokens, 1 << (left.bit_length() - 1))
        segments, loss = 0, limits.loss
        while waiting and room and segments < limits.segments:
            dots = [n * room / limits.tokens**2 + n * loss / limits.loss**2 + (limits.segments - segments) / limits.segments**2 for _, _, n in waiting]
            fits = [n <= room and n <= loss for _, _, n in waiting]
            i = max((j for j in range(len(waiting)) if fits[j] or not any(fits)), key=lambda j: (dots[j], -j))
            k, at, n = waiting[i]
            take = min(n, room, loss)
            out.append((k, at, take, sequence, tokens - room))
            room, loss, segments = room - take, loss - take, segments + 1
            if take == n:
                waiting[i] = waiting[-1]
                waiting.pop()
            else:
                waiting[i] = (k, at + take, n - take)
        sequence += 1
    return out


def test_packing_follows_the_dot_product_rule():
    rnd, limits = random.Random(4), packing.Limits(tokens=64, segments=6, loss=64, waiting=200)
    sizes = [(i, rnd.randint(1, 63)) for i in range(120)]
    packer = packing.Packer(limits, 0)
    for k, n in sizes:
        assert not list(packer.add(k, b"\0" * 4 * n, None))
    got = [(k, start, length, sequence, offset) for k, start, length, _, _, sequence, offset, _, _ in packer.rest()]
    assert got == slow_packer(sizes, limits)


def test_clashing_columns_and_odd_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (1, "x y"), (1, "x y"), (2, None)], "doc_id long, text string")
    for c in ("labels", "score", "predicted", "lang_pred", "usual", "ids", "block", "sequence_id", "n_words", "length"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted(r.n_words for r in licenses.scan(df).collect()) == [0, 2, 2, 2]
    assert packing.pack_texts(df, BPE_FILE).where("start = 0").count() == 4
    assert bpe.encode(df, BPE_FILE).count() == 4
    model = toxicity.learn([], np.zeros(0))
    assert toxicity.score(df, model).where("predicted = 0").count() == 4
    assert toxicity.score(df.where("false"), model).count() == 0
    assert packing.pack_examples(spark.createDataFrame([], "doc_id long, ids array<int>, bears array<boolean>")).count() == 0


def test_toxicity_learns_pairs():
    rnd = random.Random(4)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append(toxicity.terms(" ".join(["insult"] * a + ["group"] * b + [f"w{rnd.randint(0, 40)}" for _ in range(6)]), (1 << 18) - 1))
        labels.append(float(a and b))
    model = toxicity.learn(rows, np.array(labels), toxicity.Settings(epochs=20))
    one, two, both = (model.scores([toxicity.terms(t, (1 << 18) - 1)])[0] for t in ("insult w1", "group w1", "insult group w1"))
    assert both > 0.5 > max(one, two)


def test_toxicity_learns_a_term_that_is_neutral_alone():
    rnd, mask = random.Random(1), (1 << 18) - 1
    filler = lambda: ["w" + rnd.choice("abcdefgh") + rnd.choice("abcdefgh") for _ in range(12)]
    rows, labels = [], []
    for _ in range(16_000):
        insult, group, other = rnd.random() < 0.01, rnd.random() < 0.15, rnd.random() < 0.03
        rows.append(toxicity.terms(" ".join(["insult"] * insult + ["folk"] * group + ["slur"] * other + filler()), mask))
        labels.append(float((insult and group) or other))
    model = toxicity.learn(rows, np.array(labels))
    called = {t: (model.scores([toxicity.terms(" ".join([*t.split(), *filler()]), mask) for _ in range(200)]) >= 0.3).mean() for t in ("insult folk", "insult", "folk", "slur", "")}
    assert called["insult folk"] > 0.9 and called["slur"] > 0.9
    assert max(called["insult"], called["folk"], called[""]) < 0.1


def test_toxicity_rows(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(0, len(texts), 2)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), model).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3).astype(int)).all()
    assert toxicity.fit(docs.where("false"), labels).scores([[]])[0] > 0


def test_bpe_round_trip(docs, texts, tokenizer):
    encoded = bpe.encode(docs.withColumn("ids", F.lit("clash")), BPE_FILE)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    got = {r.doc_id: r.text for r in bpe.decode(encoded, BPE_FILE).collect()}
    assert len(ids) == len(got) == len(texts)
    for i, t in enumerate(texts):
        assert ids[i] == ids_of(tokenizer, t)
        assert got[i] == (t or "")


LONG_RUNS = {"spaces": "x " + " " * 2_000_000, "tabs": "\t" * 1_000_001 + "y", "lines": "a" + "\n" * 1_000_000 + "b", "mixed": " \n\t\r\n  " * 200_000 + "end", "word": "ab" * 1_000_000, "signs": "-=" * 300_000}


@pytest.mark.parametrize("kind", LONG_RUNS)
def test_long_runs_are_encoded_as_the_library_does(tokenizer, kind):
    got = np.frombuffer(bpe.text_encoder(BPE_FILE)(LONG_RUNS[kind]), dtype="<u4")
    assert np.array_equal(got, np.asarray(ids_of(tokenizer, LONG_RUNS[kind]), dtype="<u4"))


def test_very_long_texts_pass_through_spark(spark, tokenizer):
    some = {i: t for i, t in enumerate([LONG_RUNS["spaces"], LONG_RUNS["mixed"], LONG_RUNS["word"]])}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    n = {i: len(ids_of(tokenizer, t)) for i, t in some.items()}
    packed = packing.pack_texts(df, BPE_FILE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in packed} == n
    got = {r.doc_id: r for r in bpe.digests(bpe.round_trip(df, BPE_FILE)).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == n
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in some.items())


def test_bpe_digests(docs, texts, tokenizer):
    got = bpe.digests(bpe.round_trip(docs, BPE_FILE, block_chars=9000)).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = ids_of(tokenizer, t)
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_distinct_words_are_those_of_the_splitter(texts):
    some = [*texts, "one  two", "a\tb c", "x <|endoftext|> y\nz", "\n", " ", "end\n", None]
    for one in [some, *([t] for t in some)]:
        parts = bpe.Splitter(BPE_FILE, str).parts
        words = {w for t in one for w in parts(t or "")}
        assert bpe.distinct_words(one, BPE_FILE) == words
        assert bpe._places(one, BPE_FILE, 7)[1] == len(words)


def test_decode_of_broken_ids(spark, tokenizer):
    ids = [[220, 50256, 199], [223, 224], [], [223, 224] * 40_000]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, BPE_FILE).collect()}
    assert got == {i: tokenizer.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_empty_tables(empty):
    assert packing.pack_texts(empty, BPE_FILE).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert substring.digests(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert bpe.encode(empty, BPE_FILE).count() == 0
    assert unigram.count_tokens(empty, [("<unk>", 0.0), ("a", -1.0)]).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_nulls_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long), (None, None), (1, long), (1, long), (2, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).withColumn("starts", F.lit("x"))
    got = minhash.near_duplicates(df)
    assert got.count() == 6
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True)}
    cut = {(r.doc_id, r.n_removed) for r in substring.digests(df).collect()}
    assert cut == {(None, 0), (1, 0), (2, 80), (3, 0)}
    assert substring.remove_repeats(df).columns == df.columns
    assert packing.pack_texts(df, BPE_FILE).where("start = 0").count() == 6
    assert bpe.encode(df, BPE_FILE).count() == 6


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("wor", "thi", "sen", "lam", "pol") for b in ("ka", "de", "mi", "tor", "sal", "ren")]
    body = [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(120)]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    body[20] = body[10]
    body[31], body[33] = "a " + passage + " b", "c " + passage + " d " + body[33]
    body[40] = "123 456"
    body[41] = " ".join("".join(rnd.choice("бвгджзклмн") for _ in range(6)) for _ in range(80))
    toxic = [i for i in range(120) if i % 10 == 5]
    for i in toxic:
        body[i] += " awfulword horridword"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(body)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.toPandas()
    left = set(range(120)) - set(toxic)
    assert set(seen["toxicity"].doc_id) == left
    assert set(seen["language"].doc_id) == left - {40, 41}
    assert set(seen["near_dedup"].doc_id) == left - {40, 41, 20}
    after = seen["substring_dedup"].set_index("doc_id")
    assert after.text[31] == body[31] and after.text[33].split() == ["c", "d", *body[33].split()[72:]][: len(after.text[33].split())]
    assert passage not in after.text[33] and after.n_chars[33] == len(after.text[33])
    assert set(seen["packing"].doc_id) == set(after.index)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("wor", "thi", "sen", "lam", "pol") for b in ("ka", "de", "mi", "tor", "sal", "ren")]
    body = [" ".join(rnd.choice(words) for _ in range(70)) for _ in range(80)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(body)] + [(None, body[3], "en", "s", 1), (None, None, None, None, None), (90, "", "en", "s", 0), (4, body[4], "en", "s", 1)]
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["score", "_score", "predicted", "usual", "distance", "lang_pred", "gone", "kept", "node", "component_id", "same", "starts", "n_removed", "key"]
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(7.5 + i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert got.select(*names).distinct().count() == 1 and [got.first()[c] for c in names] == [7.5 + i for i in range(len(names))], name
        assert got.count() > 75
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).where("start = 0").count() == len(rows) and last(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_minhash_with_ids_that_stand_with_two_texts(spark):
    rnd = random.Random(11)
    a, b, c = (" ".join(str(rnd.random()) for _ in range(150)) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(1, a), (5, a), (5, b), (9, near(b)), (9, c), (9, c), (12, near(c)), (13, near(a)), (20, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("same", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, minhash.Settings(words=2)).collect())
    assert got == sorted((i, 20 if i == 20 else 1) for i, _ in rows)


def test_shared_counts_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(0, 900))) for _ in range(40)]
    rows, columns = np.arange(25), np.arange(25, 40)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
    for block in (1 << 16, 500):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert minhash.shared_counts(sets, rows, columns).tolist() == want


def test_large_families_of_long_documents_stay_in_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate((base[i % 6][rng.random(len(base[i % 6])) > 0.05], rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)))) for i in range(600)]
    tracemalloc.start()
    both = minhash.shared_counts(sets, np.arange(300), np.arange(300, 600))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and both[0, 0] > 17_000 and both[0, 1] == 0


def test_short_texts_are_packed_without_padding(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")).coalesce(1)
    got = packing.pack_texts(df, BPE_FILE).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert set(got.n) - {2048} <= {1 << i for i in range(11)} and (got.n == 2048).sum() >= len(got) - 11


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    from tesserak.llm.queries import op7_language_id, op10_toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = op7_language_id(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    got = op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.85 and hit / (got.predicted == 1).sum() > 0.95


def test_near_dedup_hands_few_texts_to_python_at_once(spark, monkeypatch):
    from tesserak.llm import shared

    key, held = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    was = spark.conf.get(key)
    monkeypatch.setattr(minhash, "cut", lambda df, name: held.append(int(spark.conf.get(key))) or shared.cut(df, name))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in minhash.near_duplicates(docs, minhash.Settings(words=2)).where("kept").collect()} == set(range(0, 20, 2))
    assert held and max(held) <= 1000 and spark.conf.get(key) == was

    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    with shared.small_batches(spark):
        assert max(r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()) <= 1000
