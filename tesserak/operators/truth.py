"""Bi-temporal truth: as-of facts, states, supersession, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import valid_at


def facts_asof(facts: DataFrame, supersessions: DataFrame, at: Column, recorded_by: Column) -> DataFrame:
    """Facts recorded by a cutoff and valid at an instant, without those whose
    replacement is itself valid then and recorded within the cutoff.

    The replacement's own row is found by an equi join on its id, and hidden facts
    leave by an anti join.
    """
    known = facts.where(F.col("recorded_at") <= recorded_by)
    live = known.where(valid_at(F.col("valid_from"), F.col("valid_to"), at))
    hidden = supersessions.join(live.select(F.col("fact_id").alias("new_id")), "new_id", "left_semi").select(F.col("old_id").alias("fact_id"))
    return live.join(hidden, "fact_id", "left_anti")


def truth_state(facts: DataFrame, supersessions: DataFrame, at: Column) -> DataFrame:
    """(fact_id, state): the first that holds of superseded, future, historical,
    unsupported (withdrawn) and supported."""
    live = facts.where(valid_at(F.col("valid_from"), F.col("valid_to"), at)).select(F.col("fact_id").alias("new_id"))
    hidden = supersessions.join(live, "new_id", "left_semi").select(F.col("old_id").alias("fact_id"), F.lit(True).alias("hidden")).distinct()
    state = (
        F.when(F.col("hidden"), "SUPERSEDED")
        .when(F.col("valid_from") > at, "FUTURE_EFFECTIVE")
        .when(F.col("valid_to").isNotNull() & (F.col("valid_to") <= at), "HISTORICAL")
        .when(F.col("withdrawn"), "UNSUPPORTED")
        .otherwise("SUPPORTED_CURRENT")
    )
    return facts.join(hidden, "fact_id", "left").select("fact_id", state.alias("state"))


def supersession_violations(facts: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Replacements that change subject or predicate, or begin before what they replace."""
    f = facts.select("fact_id", "subject", "predicate", "valid_from", "object")
    old = f.select(*[F.col(c).alias("old_" + c) for c in f.columns])
    new = f.select(*[F.col(c).alias("new_" + c) for c in f.columns])
    met = supersessions.join(old, F.col("old_id") == F.col("old_fact_id")).join(new, F.col("new_id") == F.col("new_fact_id"))
    kind = F.when((F.col("old_subject") != F.col("new_subject")) | (F.col("old_predicate") != F.col("new_predicate")), "IDENTITY").when(F.col("new_valid_from") < F.col("old_valid_from"), "ORDER").when(F.col("old_object") == F.col("new_object"), "NO_CHANGE")
    return met.select("old_id", "new_id", kind.alias("violation")).where("violation is not null")


#: The lattice of support, from none to full.
STATES = ["UNSUPPORTED", "DISPUTED", "SUPPORTED"]


def support_eval(sets: DataFrame, states: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(set_id, state) of support sets: AND over a group's references, OR over groups.

    ``sets``: (set_id, group_no, ref_kind, ref_id); a reference is to a FACT (the
    state of the set with its id) or to EVIDENCE (its state in ``states``: (ref_id,
    level 0 to 2), 2 if it isn't there).  A group is as good as its worst
    reference and a set as its best group.  Sets that refer to each other are
    found from below, so a cycle without outside support stays UNSUPPORTED.

    Runs to the fixpoint.  Sets with a single reference only pass on its state, so
    chains of them are jumped over first: each round follows a pointer's pointer,
    and the rest needs as many rounds as it is deep in sets that branch.  Raises
    after ``rounds``.
    """
    from .graph import cut

    refs = cut(sets.join(states, "ref_id", "left").select("set_id", "group_no", "ref_kind", "ref_id", F.coalesce("level", F.lit(2)).alias("level")))
    refs = cut(_jumped(refs, cut))
    deep = not refs.where("ref_kind = 'FACT'").isEmpty()
    now = cut(refs.select("set_id").distinct().withColumn("level", F.lit(0)))
    for _ in range(rounds):
        below = now.select(F.col("set_id").alias("ref_id"), F.col("level").alias("below"))
        met = refs.join(below, "ref_id", "left").select("set_id", "group_no", F.when(F.col("ref_kind") == "FACT", F.least("level", F.coalesce("below", F.lit(0)))).otherwise(F.col("level")).alias("level"))
        new = met.groupBy("set_id", "group_no").agg(F.min("level").alias("level")).groupBy("set_id").agg(F.max("level").alias("level"))
        changed = cut(new.join(now.withColumnRenamed("level", "was"), "set_id"))
        now = changed.select("set_id", "level")
        if not deep or changed.where("level <> was").isEmpty():
            return now.select("set_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("level") + 1).alias("state"))
    raise RuntimeError(f"support is not settled after {rounds} rounds")


def _jumped(refs: DataFrame, cut) -> DataFrame:
    """References with those to sets of a single reference led on to where that leads.

    A pointer carries the least level on its way.  Pointers in a cycle never leave
    it; they are followed as often as the longest chain could need and then stay
    references into the cycle, which stays at its lowest state.
    """
    own = Window.partitionBy("set_id")
    single = cut(refs.withColumn("n", F.count("*").over(own)).where("n = 1 and ref_kind = 'FACT'").select("set_id", "ref_id", "level"))
    total = single.count()
    steps = 0
    while (1 << steps) < total + 1:
        steps += 1
        further = single.select(F.col("set_id").alias("mid"), F.col("ref_id").alias("on"), F.col("level").alias("low"))
        met = single.join(further, F.col("ref_id") == F.col("mid"), "left")
        led = cut(met.select("set_id", F.coalesce("on", "ref_id").alias("ref_id"), F.least("level", F.coalesce("low", F.lit(2))).alias("level"), F.col("mid").isNotNull().alias("moved")))
        single = led.select("set_id", "ref_id", "level")
        if led.where("moved").isEmpty():
            break
    ends = single.select(F.col("set_id").alias("s"), F.col("ref_id").alias("end"), F.col("level").alias("low"))
    return refs.join(ends, (F.col("ref_kind") == "FACT") & (F.col("ref_id") == F.col("s")), "left").select("set_id", "group_no", "ref_kind", F.coalesce("end", "ref_id").alias("ref_id"), F.least("level", F.coalesce("low", F.lit(2))).alias("level"))


def validate_derived(items: DataFrame, dependencies: DataFrame, cutoff: Column) -> DataFrame:
    """(item_id, state, valid) by an item's latest dependency up to a cutoff.

    No dependency at all: UNANNOTATED, valid.  Only later ones: UNSUPPORTED.
    ``dependencies``: (item_id, at, seq, state).  One conditional aggregate.
    """
    latest = F.max(F.when(F.col("at") <= cutoff, F.struct("at", "seq", "state")))
    found = dependencies.groupBy("item_id").agg(latest.alias("latest"))
    met = items.select("item_id").join(found.withColumn("any", F.lit(True)), "item_id", "left")
    state = F.when(F.col("any").isNull(), "UNANNOTATED").when(F.col("latest").isNull(), "UNSUPPORTED").otherwise(F.col("latest.state"))
    return met.select("item_id", state.alias("state"), (state != "UNSUPPORTED").alias("valid"))


def interval_overlap_pairs(rows: DataFrame, keys: list[str], bucket_seconds: int) -> DataFrame:
    """(a, b): rows of equal keys with different objects and overlapping half-open
    intervals, a < b.

    Each interval is copied to the time buckets that it covers, so a key with very
    many rows is spread by time; a pair counts in the bucket of its later start.
    ``rows``: (id, *keys, object, start, end) with epoch seconds; a null end is
    open and must be bounded by the caller.
    """
    size = F.lit(bucket_seconds)
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1e-6) / size).cast("long")
    left = rows.select(*keys, F.explode(F.sequence(first, F.greatest(first, last))).alias("bucket"), F.col("id").alias("a"), F.col("object").alias("a_object"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = left.select(*keys, "bucket", *[F.col("a" + c).alias("b" + c) for c in ("", "_object", "_start", "_end")])
    met = left.join(right, [*keys, "bucket"]).where("a < b and a_object <> b_object and a_start < b_end and b_start < a_end")
    return met.where(F.floor(F.greatest("a_start", "b_start") / size) == F.col("bucket")).select("a", "b")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` of each key, as an aggregate that combines before
    the shuffle (a window would move every row)."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in [*order, *rest]])


def revision_chain(rows: DataFrame) -> DataFrame:
    """(vault, seq, hash): each revision's hash over the one before and its content.

    ``rows``: (vault, seq, content).  A hash over a hash can't be taken in parallel, so
    a vault's revisions go through one task in order; they pass by in batches with
    the last hash carried, and no vault is held as a whole.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        vault, last = None, ""
        for b in batches:
            out = []
            for v, content in zip(b.column("vault").to_pylist(), b.column("content").to_pylist(), strict=True):
                if v != vault:
                    vault, last = v, ""
                last = hashlib.sha256(f"{last}|{content}".encode()).hexdigest()
                out.append(last)
            yield pa.record_batch([b.column("vault"), b.column("seq"), pa.array(out, pa.string())], ["vault", "seq", "hash"])

    ordered = rows.select(F.col("vault").cast("string").alias("vault"), F.col("seq").cast("long").alias("seq"), "content").repartition("vault").sortWithinPartitions("vault", "seq")
    return ordered.mapInArrow(run, "vault string, seq long, hash string")
