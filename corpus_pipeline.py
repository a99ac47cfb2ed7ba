"""A corpus pipeline over ``documents``: five stages, each an operator of tesserak.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``, and any others that
came with them, unchanged, whatever their names.  Repeated rows are judged alike and
each of them stays or goes; rows with a null doc_id are documents of their own to
near dedup and earlier than all others to substring dedup; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserak.llm import langid, minhash, packing, substring, toxicity
from tesserak.llm.queries import BPE_FILE, table
from tesserak.llm.shared import cut, free_name


def decided(docs: DataFrame, names: list[str], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps.  Its operator adds columns ``names``;
    columns of those names that ``docs`` has step aside for it."""
    aside = {c: free_name(docs, c) for c in docs.columns if c.lower() in names}
    return decide(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go; a null text is scored
    as an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return decided(docs, ["score", "predicted"], lambda rows: toxicity.score(rows, model).where("predicted = 0"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those without letters, and those that are
    farther from the nearest profile than learned texts of their size are.  A null text
    has no letters."""
    profiles = langid.fit(docs)
    return decided(docs, ["lang_pred", "score", "distance", "usual"], lambda rows: langid.identify(rows, profiles).where("usual"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest id stays.  Texts
    without words and rows without an id stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out, and
    ``n_chars`` becomes that of what is left; a null text stays null."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: a row per piece, with its ids.  A null text gives
    its end id; other columns end here."""
    return packing.pack_texts(docs, BPE_FILE, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned stages; tests/llm plants documents for each stage and
#: compares both dedup stages and packing with brute force on what came into them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
