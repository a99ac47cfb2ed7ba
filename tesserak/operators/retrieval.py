"""Exact and lexical candidates, rerank, fusion and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Channel weights of the fusion.
CHANNEL_WEIGHT = {"exact": 3.0, "context-pack": 2.5, "lexical": 1.5, "graph": 1.4, "code": 1.2, "raw": 1.2, "vector": 1.0, "ppr": 1.0, "community": 1.0}
FIELD_WEIGHT = {"external_id": 32.0, "path": 24.0, "title": 20.0, "body": 2.0}
#: What a match is called, in order of precedence, and a unit's own weight.
REASONS = {"external_id": "lexical:external-id-terms", "path": "lexical:path-terms", "title": "lexical:title-terms", "unit": "lexical:unit-terms", "body": "lexical:body-terms"}
UNIT_WEIGHT = 1.0
#: Channels whose hits are support by themselves.
DIRECT_CHANNELS = ["exact", "code", "raw", "context-pack", "temporal"]


#: An abbreviation inside a question of several words, and how many count.
ACRONYM = r"\b[A-Z][A-Z0-9]{2,7}\b"
ACRONYMS = 3


def exact_lookup(docs: DataFrame, lookups: DataFrame) -> DataFrame:
    """(query_id, doc_id, match_rank): rows whose id (0), an alias (1), title (2) or path
    (3) equals the lookup, without regard to case, or whose id ends with an abbreviation
    of the lookup, or has it as alias (4); the best rank of a pair counts.

    Abbreviations count for a lookup only if they lead to one document.  Each key is an
    equi join of its own, so it can shuffle on that key.
    """
    wanted = lookups.select("query_id", F.lower("lookup").alias("wanted"))
    named = docs.select("doc_id", F.explode("aliases").alias("alias"))
    keys = {0: docs.select("doc_id", F.lower("external_id").alias("wanted")), 1: named.select("doc_id", F.lower("alias").alias("wanted")), 2: docs.select("doc_id", F.lower("title").alias("wanted")), 3: docs.select("doc_id", F.lower("path").alias("wanted"))}
    found = None
    for rank, rows in keys.items():
        part = rows.join(wanted, "wanted").select("query_id", "doc_id", F.lit(rank).alias("match_rank"))
        found = part if found is None else found.unionByName(part)
    several = F.size(F.split(F.trim("lookup"), r"\s+")) > 1
    short = F.slice(F.array_distinct(F.regexp_extract_all("lookup", F.lit(ACRONYM), F.lit(0))), 1, ACRONYMS)
    asked = lookups.where(several).select("query_id", "lookup", F.explode(short).alias("acronym")).select("query_id", "lookup", F.lower("acronym").alias("wanted"))
    ends = docs.where(F.contains("external_id", F.lit("-"))).select("doc_id", F.lower(F.substring_index("external_id", "-", -1)).alias("wanted"))
    led = ends.unionByName(keys[1]).join(asked, "wanted").select("query_id", "lookup", "doc_id").distinct()
    lone = led.groupBy("query_id", "lookup").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
    found = found.unionByName(lone.select("query_id", "doc_id", F.lit(4).alias("match_rank")))
    return found.groupBy("query_id", "doc_id").agg(F.min("match_rank").alias("match_rank"))


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, doc_id): distinct terms of all fields together."""
    every = F.array_distinct(F.flatten(F.array(*[text.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields])))
    return docs.select(F.explode(every).alias("term"), "doc_id")


def lexical_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw_score, reason) of documents with a field that holds every
    term of the query: the sum of those fields' weights, and one for a line that does.

    ``docs``: (doc_id, external_id, path, title, body); ``queries``: (query_id, terms).
    A document that holds all terms holds the rarest one, so only that term of a
    query is joined with the postings; the others are looked up in the rows found.
    A term's count and its postings are read for the queries' own words alone.
    """
    fields = list(FIELD_WEIGHT)
    wanted = queries.where(F.size("terms") > 0)
    posted = postings(docs, fields).join(wanted.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    held = posted.groupBy("term").agg(F.count("*").alias("n"))
    terms = wanted.select("query_id", F.explode("terms").alias("term")).join(held, "term", "left")
    rarest = terms.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("least"))
    rarest = rarest.where("least.n > 0").select("query_id", F.col("least.term").alias("term"))
    met = posted.join(rarest, "term").select("query_id", "doc_id").join(wanted, "query_id").join(docs.select("doc_id", *fields), "doc_id")
    has = lambda c: F.size(F.array_except("terms", text.tokens(F.coalesce(c, F.lit(""))))) == 0
    rows = met.select("query_id", "doc_id", *[has(F.col(f)).alias(f) for f in fields], F.exists(F.split(F.coalesce("body", F.lit("")), "\n"), has).alias("unit"))
    score = sum((F.when(F.col(f), w).otherwise(0.0) for f, w in {**FIELD_WEIGHT, "unit": UNIT_WEIGHT}.items()), F.lit(0.0))
    reason = F.lit(None).cast("string")
    for f, name in reversed(REASONS.items()):
        reason = F.when(F.col(f), F.lit(name)).otherwise(reason)
    return rows.where(" or ".join(fields)).select("query_id", "doc_id", score.alias("raw_score"), reason.alias("reason"))


def ranked(candidates: DataFrame, order: list, channel: str) -> DataFrame:
    """Candidates of a channel, numbered per query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return candidates.select("query_id", "doc_id", F.lit(channel).alias("channel"), rank.cast("long").alias("rank"))


def rrf_fuse(channels: DataFrame, limit: int | None = None, k: int = 60, weighted: bool = True) -> DataFrame:
    """Reciprocal-rank fusion of rows (query_id, doc_id, channel, rank).

    A document's best rank in a channel counts once; contributions are summed in
    the order of channels, so sums don't depend on partitions; ties go to the
    smaller doc_id.
    """
    weights = F.create_map(*[x for c, w in CHANNEL_WEIGHT.items() for x in (F.lit(c), F.lit(w))])
    best = channels.groupBy("query_id", "doc_id", "channel").agg(F.min("rank").alias("rank"))
    weight = F.coalesce(weights[F.col("channel")], F.lit(1.0)) if weighted else F.lit(1.0)
    parts = best.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("channel", (weight / (k + F.col("rank"))).alias("part")))).alias("parts"))
    scored = parts.select("query_id", "doc_id", F.round(F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["part"]), 8).alias("score"), F.array_join(F.transform("parts", lambda p: p["channel"]), ",").alias("channels"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    out = scored.withColumn("rank", rank.cast("long"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def lexical_rerank(hits: DataFrame) -> DataFrame:
    """Add 0.001 per distinct query term (3 characters or more) that the hit's text
    holds as a substring; ties keep their former rank.

    ``hits``: (query_id, doc_id, score, rank, query, content).
    """
    terms = F.array_distinct(F.filter(text.tokens(F.col("query")), lambda t: F.length(t) >= 3))
    low = F.lower("content")
    met = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    scored = hits.select("query_id", "doc_id", "rank", F.round(F.col("score") + met * 0.001, 8).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")
    return scored.select("query_id", "doc_id", "score", F.row_number().over(order).cast("long").alias("new_rank"))


def passage_support(hits: DataFrame) -> DataFrame:
    """Whether a passage supports a query: its salient tokens overlap in at least
    min(2, n) and cover at least 0.4 of the query's.

    ``hits``: (query_id, doc_id, query, content).
    """
    want, have = text.salient(F.col("query")), text.salient(F.col("content"))
    rows = hits.select("query_id", "doc_id", F.size(want).alias("n"), F.size(F.array_intersect(want, have)).alias("overlap"))
    share = F.col("overlap") / F.greatest(F.col("n"), F.lit(1))
    ok = (F.col("n") > 0) & (F.col("overlap") >= F.least(F.lit(2), F.greatest(F.col("n"), F.lit(1)))) & (share >= 0.4)
    return rows.select("query_id", "doc_id", F.col("overlap").cast("long").alias("overlap"), F.round(share, 6).alias("coverage"), ok.alias("supported"))


def support_reasons(hits: DataFrame, support: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, reason, supported) of hits (query_id, doc_id, rank,
    channels): support by a direct channel comes before that of the passage's text.

    ``channels``: names joined by commas; ``support``: rows of passage_support().
    """
    direct = F.arrays_overlap(F.split("channels", ","), F.array(*map(F.lit, DIRECT_CHANNELS)))
    reason = F.when(direct, "DIRECT_CHANNEL_SUPPORT").when(F.coalesce("supported", F.lit(False)), "PASSAGE_TEXT_SUPPORT").otherwise("PASSAGE_SUPPORT_NOT_DEMONSTRATED")
    met = hits.join(support.select("query_id", "doc_id", "supported"), ["query_id", "doc_id"], "left")
    return met.select("query_id", "doc_id", "rank", reason.alias("reason"), (reason != "PASSAGE_SUPPORT_NOT_DEMONSTRATED").alias("supported"))


def answerability(queries: DataFrame, reasons: DataFrame, vector_scores: DataFrame) -> DataFrame:
    """(query_id, supported, reason, n_supported, top_vector, margin, neighbourhood).

    ``reasons``: rows of support_reasons(); ``vector_scores``: (query_id, doc_id,
    score) of the vector channel.  The reason is the strongest of the supported
    hits, NO_CANDIDATES without any hit.  Margins are from the best vector score to
    the second, and to the third (or second) as neighbourhood.
    """
    kinds = reasons.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("supported").alias("n_supported"), F.max(F.col("reason") == "DIRECT_CHANNEL_SUPPORT").alias("direct"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = vector_scores.withColumn("n", F.row_number().over(order)).where("n <= 3").groupBy("query_id").agg(*[F.max(F.when(F.col("n") == i, F.col("score"))).alias(f"s{i}") for i in (1, 2, 3)])
    met = queries.select("query_id").join(kinds, "query_id", "left").join(top, "query_id", "left")
    reason = F.when(F.col("n").isNull(), "NO_CANDIDATES").when(F.col("n_supported") == 0, "SUPPORT_NOT_DEMONSTRATED").when(F.col("direct"), "DIRECT_CHANNEL_SUPPORT").otherwise("PASSAGE_TEXT_SUPPORT")
    return met.select(
        "query_id",
        (F.coalesce("n_supported", F.lit(0)) > 0).alias("supported"),
        reason.alias("reason"),
        F.coalesce("n_supported", F.lit(0)).alias("n_supported"),
        F.col("s1").alias("top_vector"),
        F.round(F.col("s1") - F.col("s2"), 6).alias("margin"),
        F.round(F.col("s1") - F.coalesce("s3", "s2", "s1"), 6).alias("neighbourhood"),
    )


def partition_hits(queries: DataFrame, reasons: DataFrame) -> DataFrame:
    """(query_id, outcome, supported, exploratory): hits that support an answer and the
    others, each in rank order, and what came out for the query."""
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("rank", "doc_id")))), lambda r: r["doc_id"])
    found = reasons.groupBy("query_id").agg(listed(F.col("supported")).alias("supported"), listed(~F.col("supported")).alias("exploratory"))
    none = F.array().cast("array<long>")
    met = queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("supported", none).alias("supported"), F.coalesce("exploratory", none).alias("exploratory"))
    outcome = F.when(F.size("supported") > 0, "SUPPORTED").when(F.size("exploratory") > 0, "EXPLORATORY_ONLY").otherwise("NO_CANDIDATES")
    return met.select("query_id", outcome.alias("outcome"), F.array_join("supported", ",").alias("supported"), F.array_join("exploratory", ",").alias("exploratory"))


#: Places of trust tiers and of freshness in the order of candidates.
AUTHORITY = ["ATTESTED", "HUMAN_REVIEWED", "MACHINE_SUPPORTED", "UNVERIFIED"]
FRESHNESS = ["FRESH", "STALE_PENDING_REVIEW"]


def candidate_order(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, place): mandatory ones first, then by retrieval rank, trust,
    freshness, citations, score and id."""
    at = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("mandatory"), F.asc_nulls_last("rank"), at(AUTHORITY, "trust"), at(FRESHNESS, "freshness"), F.desc("citations"), F.desc("score"), "doc_id")
    return candidates.select("query_id", "doc_id", F.row_number().over(order).cast("long").alias("place"))


def one_line(value: Column, limit: int = 320) -> Column:
    """White space as single blanks, cut at the last blank that leaves 0.6 of the
    limit, with an ellipsis."""
    flat = F.trim(F.regexp_replace(value, r"[ \t\r\n]+", " "))
    head = F.substring(flat, 1, limit)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    end = F.when((F.instr(head, " ") > 0) & (last >= int(limit * 0.6)), last).otherwise(limit - 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, F.lit(1), end.cast("int"))), F.lit("…")))


def disclosed(candidates: DataFrame, level: str) -> DataFrame:
    """(query_id, doc_id, level, content, tokens) of candidates (…, catalog, content,
    full) at a level: L0 the catalog entry, L1 one line, L2 the passage, L3 all."""
    line = one_line(F.col("content"))
    pick = {"L0": F.col("catalog"), "L1": F.when(line != "", line).otherwise(F.col("catalog")), "L2": F.col("content"), "L3": F.when(F.trim("full") != "", F.trim("full")).otherwise(F.col("content"))}[level]
    return candidates.select("query_id", "doc_id", F.lit(level).alias("level"), pick.alias("content")).withColumn("tokens", text.token_estimate(F.col("content")))


def best_term_window(value: Column, terms: Column, size: int = 200) -> Column:
    """Up to ``size`` characters around the first place of the term that stands first:
    from 60 characters before it.  Without any term: the beginning."""
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(value), t)), lambda i: i > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 60, F.lit(1))
    return F.substring(value, start, F.lit(size))


def diversity_interleave(sections: DataFrame, most: int = 3) -> DataFrame:
    """Round-robin over documents, at most ``most`` sections each.

    ``sections``: (query_id, doc_id, doc_rank, section).  Sections of a document
    are numbered; the order is (round, document rank).
    """
    turn = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("section"))
    kept = sections.withColumn("turn", turn).where(F.col("turn") <= most)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "doc_rank", "doc_id"))
    return kept.select("query_id", "doc_id", "section", F.col("turn").cast("long").alias("turn"), place.cast("long").alias("place"))


def pack_by_estimate(sections: DataFrame, budget: int) -> DataFrame:
    """Sections (query_id, place, doc_id, section, tokens) up to a token budget: the
    longest prefix, by place, whose estimated tokens fit."""
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", used.cast("long")).where(F.col("used") <= budget).select("query_id", "place", "doc_id", "section", F.col("tokens").cast("long").alias("tokens"), "used")


def merge_variants(rows: DataFrame) -> DataFrame:
    """Best row per (query, document) over query variants: the highest score, then the
    variant that isn't transformed.  ``rows``: (query_id, doc_id, score, variant)."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "variant")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
