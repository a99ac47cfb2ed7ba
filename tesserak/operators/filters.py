"""Governance predicates: scope, trust, mode, lifecycle, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bind import TRUST

#: The layers that each search mode reads.
MODE_LAYERS = {"RAW_ONLY": ["SOURCE", "RESOURCE"], "COMPILED_ONLY": ["COMPILED", "PROJECT", "CONTEXT_PACK"]}


def canonical_prefix(prefix: Column) -> Column:
    """A path prefix with slashes and without one at its end; the empty one, or none, is
    the whole vault.  Null if it isn't a relative path of plain segments."""
    flat = F.regexp_replace(F.coalesce(prefix, F.lit("")), r"\\", "/")
    path = F.regexp_replace(flat, "/+$", "")
    segments = F.split(path, "/")
    odd = F.exists(segments, lambda s: s.isin("", ".", "..") | s.rlike(r"[:\x00-\x1f]"))
    return F.when(flat == "", "").when(~flat.startswith("/") & ~odd, path)


def permitted(scopes: DataFrame) -> DataFrame:
    """(vault, prefix): what all scopes (vault, prefix) of a vault permit together.

    Prefixes are canonical, with null for the whole vault.  A vault with a malformed
    prefix, or with two of which neither lies under the other, is permitted nothing.
    """
    under = lambda path, p: (p == "") | (path == p) | path.startswith(F.concat(p, F.lit("/")))
    each = scopes.select("vault", canonical_prefix(F.col("prefix")).alias("prefix"))
    own = each.groupBy("vault").agg(F.max_by("prefix", F.length("prefix")).alias("last"), F.collect_set("prefix").alias("held"), F.bool_and(F.col("prefix").isNotNull()).alias("sound"))
    return own.where(F.col("sound") & F.forall("held", lambda p: under(F.col("last"), p))).select("vault", F.nullif("last", F.lit("")).alias("prefix"))


def scope_filter(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows that the scopes (vault, prefix) of their vault permit together.

    A null prefix permits the vault; otherwise the path equals the prefix or lies
    under it.  A semi join on the vault with the path as a residual predicate, so
    rows are neither copied nor widened.
    """
    s = permitted(scopes).select(F.col("vault").alias("_vault"), F.col("prefix").alias("_prefix"))
    under = F.col("_prefix").isNull() | (F.col("path") == F.col("_prefix")) | F.col("path").startswith(F.concat("_prefix", F.lit("/")))
    return rows.join(F.broadcast(s), (rows.vault == F.col("_vault")) & under, "left_semi")


def at_least(tier: Column, least: str) -> Column:
    """Trust tiers compared by rank; an unknown tier is below all."""
    rank = F.create_map(*[x for i, t in enumerate(TRUST) for x in (F.lit(t), F.lit(i))])
    return F.coalesce(rank[tier], F.lit(-1)) >= TRUST.index(least)


def trust_filter(rows: DataFrame, least: str) -> DataFrame:
    return rows.where(at_least(F.col("trust"), least))


def lifecycle_freshness_filter(rows: DataFrame, drafts: bool = False) -> DataFrame:
    live = ["ACTIVE", "DISPUTED"] + ["DRAFT"] * drafts
    return rows.where(F.col("lifecycle").isin(live) & ~F.col("freshness").isin("STALE_BLOCKED", "INVALID"))


def mode_filter(rows: DataFrame, mode: str) -> DataFrame:
    layers = MODE_LAYERS.get(mode)
    return rows if layers is None else rows.where(F.col("layer").isin(layers))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end; a null end is open."""
    return (start <= at) & (end.isNull() | (end > at))


def contains_pairs(payload: Column, wanted: dict[str, str]) -> Column:
    """Whether a JSON text holds each of some top-level pairs."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.get_json_object(payload, f"$.{k}") == v)
    return F.coalesce(out, F.lit(False))
