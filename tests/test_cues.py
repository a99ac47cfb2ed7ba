"""Support by cues, plans of queries: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tesserak.functions import cues, planning


@pytest.mark.parametrize(
    ("query", "passage", "rank", "reason"),
    [
        ("how to rotate signing keys", "Signing keys must be rotated; rotate them via the console", None, "PASSAGE_TEXT_SUPPORT"),
        ("how to rotate signing keys", "Signing keys rotate", None, "ANSWER_CUE_MISMATCH"),
        ("why is caching costly", "unrelated words because of overhead", 3, "PASSAGE_CUE_SUPPORT"),
        ("why is caching costly", "unrelated words because of overhead", 6, "PASSAGE_SUPPORT_NOT_DEMONSTRATED"),
        ("cuándo usar caché distribuida", "usar caché distribuida sólo cuando el umbral sube", None, "PASSAGE_TEXT_SUPPORT"),
        ("what is a ledger", "a ledger means a list of entries", None, "PASSAGE_TEXT_SUPPORT"),
        ("ADR-how", "adr how is here", None, "ANSWER_CUE_MISMATCH"),
        ("ADR-HOW", "adr how is here", None, "PASSAGE_TEXT_SUPPORT"),
        ("ADR-12", "see adr 12 for it", None, "PASSAGE_TEXT_SUPPORT"),
        ("ledger entries", "  ", 1, "NO_CONCRETE_PASSAGE"),
        ("avoid duplicated side effects", "it is idempotent, so effects side with duplicated events", None, "PASSAGE_TEXT_SUPPORT"),
    ],
)
def test_support_of_passages(spark, query, passage, rank, reason):
    df = spark.createDataFrame([(query, passage, rank)], "query string, passage string, rank int")
    rows = df.withColumn("q", cues.folded("query")).withColumn("p", cues.folded("passage")).withColumn("q", cues.words(F.col("q"))).withColumn("p", cues.words(F.col("p")))
    found = cues.signal(F.col("query"), F.col("q"), F.col("passage"), F.col("p"), F.col("rank"))
    got = rows.select(*[c.alias(n) for n, c in found.items()]).first()
    assert got.reason == reason and got.supported == reason.endswith(("TEXT_SUPPORT", "CUE_SUPPORT"))


def test_an_echo_of_the_query_is_no_answer():
    assert not cues.retains("as asked: how must keys rotate", "how must keys rotate")
    assert cues.retains("how must keys rotate? submit a request, then wait", "How must keys rotate")
    assert cues.retains("see DOC-7 there", "doc-7") and not cues.retains("see DOC-8", "doc-7") and not cues.retains("x", " ")
    assert cues.asked("DOC-7") == [] and cues.asked("why when") == ["CONDITION", "RATIONALE"]


def test_plans(spark):
    rows = [
        ("What is the impact of this", None, True, "IMPACT_ANALYSIS", "ASSOCIATIVE", "exact,graph", 3),
        ("What is the impact of this", None, False, "IMPACT_ANALYSIS", "LOCAL", "exact", 0),
        ("compare a and b", None, False, "COMPARISON", "LOCAL", "exact,lexical", 0),
        ("see ADR-12_B", None, True, "EXACT_LOOKUP", "LOCAL", "exact,lexical", 0),
        ("sources of it", None, True, "CONCEPTUAL", "DRIFT", "exact,lexical,vector", 0),
        ("source of it", " global_synthesis ", True, "GLOBAL_SYNTHESIS", "GLOBAL", "lexical,vector,graph", 1),
        (None, "unknown", True, "CONCEPTUAL", "DRIFT", "exact,lexical,vector", 0),
        ("dependencies of x", "", True, "IMPACT_ANALYSIS", "ASSOCIATIVE", "exact,graph", 3),
        ("no retrieval", "no_retrieval_required", True, "NO_RETRIEVAL_REQUIRED", "LOCAL", "", 0),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, query string, requested string, can boolean")
    found = planning.plan(F.col("query"), F.col("requested"), lambda _: F.col("can"))
    got = df.select("i", *[c.alias(n) for n, c in found.items()]).orderBy("i").collect()
    assert [(g.intent, g.strategy, ",".join(g.channels), g.max_hops) for g in got] == [r[3:] for r in rows]
    assert got[3].shapes == ["EXACT_IDENTIFIER"] and "SOURCE_VERIFICATION" in got[5].shapes and got[5].per_document == 1
