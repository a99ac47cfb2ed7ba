"""Passages and the documents that hold them, against brute force."""

import random

from tesserak.operators import evaluation
from tesserak.plans import analytics

PASSAGES = [
    (0, "ne two three fo"),
    (1, "wo thr"),  # both words are cut
    (2, "  "),
    (3, "hree"),
    (4, "three\nfour  five"),
    (5, "one zero two"),
    (6, "ne two three fo"),
    (7, "Three four"),
    (8, None),
    (9, "five ünd "),
]
TEXTS = [(1, "one two three four"), (2, "two three"), (3, None), (4, "x three\nfour  five ünd six"), (5, ""), (6, "one two Three four two three"), (7, "one  two")]


def held(passages, texts):
    return {(q, d) for q, p in passages for d, t in texts if p is not None and t is not None and p in t}


def test_holders_of_cut_and_short_passages(spark, tmp_path):
    passages = spark.createDataFrame(PASSAGES, "item_id long, text string")
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    passages.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = analytics._gold(spark, str(tmp_path)).collect()
    assert sorted(r.query_id for r in got) == list(range(10))
    assert {(r.query_id, d) for r in got for d in r.gold} == held(PASSAGES, TEXTS)


def test_holders_by_blocks(spark):
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice("ab bc c dd e".split()) for _ in range(30))) for i in range(60)]
    passages = [(i, t[rnd.randrange(20) :][: rnd.randrange(1, 25)]) for i, (_, t) in enumerate(texts)]
    found = evaluation.holders(spark.createDataFrame(passages, "query_id long, needle string"), spark.createDataFrame(texts, "doc_id long, text string"), most=100)
    rows = [tuple(r) for r in found.collect()]
    assert len(set(rows)) == len(rows) and set(rows) == held(passages, texts)
