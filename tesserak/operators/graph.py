"""Graph operators over edges (from_id, to_id, relation, weight).

Walks are loops of equi joins over edges ranked once beforehand; fixpoints cut
their lineage by a written table each round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session's cluster shares.  Only a local session may choose a
    folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tesserak-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserak-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_apart(df: DataFrame) -> DataFrame:
    """cut(), for tables of a fixpoint: their joins are by shuffles, for a broadcast would
    bring the table to the driver in each round."""
    return cut(df).hint("merge")


def oriented(edges: DataFrame) -> DataFrame:
    """Edges both ways: (src, dst, relation, weight)."""
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "relation", "weight")
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "relation", "weight")
    return out.unionByName(back)


def strongest(edges: DataFrame, fan_out: int) -> DataFrame:
    """The ``fan_out`` edges of each source with the highest weight, then least target."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "relation"))
    return edges.withColumn("_n", rank).where(F.col("_n") <= fan_out).drop("_n")


def walks(seeds: DataFrame, edges: DataFrame, hops: int, decay: float) -> DataFrame:
    """Simple paths (seed, node, hops, score, path) of 1 to ``hops`` edges.

    ``seeds``: (seed); ``edges``: (src, dst, weight), already cut to a fan-out.  A
    path's score is the product of weight times decay over its edges.
    """
    level = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("score"), F.array("seed").alias("path"))
    e = edges.select("src", "dst", "weight")
    out = None
    for hop in range(1, hops + 1):
        step = level.join(e, level.node == e.src).where(~F.array_contains("path", F.col("dst")))
        level = step.select("seed", F.col("dst").alias("node"), (F.col("score") * F.col("weight") * decay).alias("score"), F.array_append("path", F.col("dst")).alias("path"))
        rows = level.select("seed", "node", F.lit(hop).cast("long").alias("hops"), "score", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def expand_graph(seeds: DataFrame, edges: DataFrame, hops: int = 3, decay: float = 0.5, fan_out: int = 50) -> DataFrame:
    """(node, score): outgoing simple paths from all seeds along each node's ``fan_out``
    strongest edges, their scores summed."""
    e = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "weight", "relation")
    return walks(seeds, strongest(e, fan_out), hops, decay).groupBy("node").agg(F.round(F.sum("score"), 6).alias("score"))


def weighted_paths(seeds: DataFrame, edges: DataFrame, hops: int = 3, fan_out: int = 10, decay: float = 0.5, kept: int = 3) -> DataFrame:
    """(node, score, paths): the ``kept`` best paths to each node both ways, summed."""
    paths = walks(seeds, strongest(oriented(edges), fan_out), hops, decay)
    # relations may join two nodes twice; a path counts once, with its best score
    paths = paths.groupBy("seed", "node", "hops", "path").agg(F.max("score").alias("score"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "hops", "seed", F.array_join("path", ">"))
    best = paths.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= kept)
    return best.groupBy("node").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("paths"))


def best_paths(seeds: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(seed, node, hops, signature): the shortest path to each node, and of equal ones
    the least by its nodes' names.  Breadth first: a node that is reached is closed."""
    e = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
    reached = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hops"), F.col("seed").alias("signature")))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(e, frontier.node == e.src).select("seed", F.col("dst").alias("node"), F.concat_ws(">", "signature", "dst").alias("signature"))
        new = step.groupBy("seed", "node").agg(F.min("signature").alias("signature")).join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(new.select("seed", "node", F.lit(hop).cast("long").alias("hops"), "signature"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("hops > 0")


def closure(seeds: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, depth): what depends, directly or not, on the seeds (edges followed
    backwards), up to ``hops`` or to the fixpoint; the least depth of a node."""
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("node")).distinct()
    reached = cut(seeds.select(F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    frontier, depth = reached, 0
    while hops is None or depth < hops:
        depth += 1
        new = frontier.select(F.col("node").alias("src")).join(back, "src").select("node").distinct().join(reached, "node", "left_anti")
        frontier = cut(new.select("node", F.lit(depth).cast("long").alias("depth")))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached.where("depth > 0")


def one_hop_neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, weight, relation): other ends of edges at a seed: greatest weight, least relation."""
    near = oriented(edges).join(seeds, F.col("src") == F.col("seed"), "left_semi").select(F.col("dst").alias("node"), "weight", "relation")
    found = near.groupBy("node").agg(F.max("weight").alias("weight"), F.min("relation").alias("relation"))
    return found.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")


def graph_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("total_weight"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node name that undirected edges reach."""
    both = kept_apart(oriented(edges).select("src", "dst").distinct())
    labels = kept_apart(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.node == near.src, "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        met = kept_apart(met.join(jump, "low").select("node", "was", F.least("low", "lower").alias("component")))
        labels = met.select("node", "component")
        if met.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components are not found after {rounds} rounds")


def ppr(seeds: DataFrame, edges: DataFrame, rounds: int = 5, restart: float = 0.15, tolerance: float | None = None, cut_every: int = 5) -> DataFrame:
    """(node, score): personalized PageRank of rows (seed, weight).

    Equal edges keep the greatest weight.  What nodes without outgoing edges hold
    goes back to the seeds.  Runs ``rounds`` rounds; looks every ``cut_every``
    rounds, when lineage is cut, and stops if scores change by ``tolerance`` in sum.
    """
    e = edges.groupBy("from_id", "to_id", "relation").agg(F.max("weight").alias("weight")).groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    share = cut(e.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("from_id"))).select("from_id", "to_id", "share"))
    start = seeds.groupBy(F.col("seed").alias("node")).agg(F.sum("weight").alias("w"))
    nodes = share.select(F.col("from_id").alias("node")).union(share.select("to_id")).union(start.select("node")).distinct()
    total = start.agg(F.sum("w").alias("total"))
    start = start.crossJoin(F.broadcast(total)).select("node", (F.col("w") / F.col("total")).alias("p"))  # one row
    base = cut(nodes.join(start, "node", "left").join(share.select(F.col("from_id").alias("node"), F.lit(True).alias("out")).distinct(), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("out", F.lit(False)).alias("out")))
    state = base.select("node", "p", "out", F.col("p").alias("score"))
    for i in range(rounds):
        flow = state.join(share, state.node == share.from_id).groupBy(F.col("to_id").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        stuck = state.agg(F.sum(F.when(~F.col("out"), F.col("score")).otherwise(0.0)).alias("stuck"))
        new = state.join(flow, "node", "left").crossJoin(F.broadcast(stuck))  # one row
        new = new.select("node", "p", "out", F.col("score").alias("was"), (restart * F.col("p") + (1 - restart) * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") * F.col("p"))).alias("score"))
        looked = (i + 1) % cut_every == 0
        if looked:
            new = cut(new)
        state = new.select("node", "p", "out", "score")
        if looked and tolerance is not None and new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] <= tolerance:
            break
    return state.select("node", F.round("score", 8).alias("score"))


def ppr_push(seeds: DataFrame, edges: DataFrame, restart: float = 0.15, tolerance: float = 0.01, most: int = 500) -> DataFrame:
    """(query_id, node, score): personalized PageRank of many seed sets (query_id, seed,
    weight) at once, each within ``tolerance`` of the true one in the sum of differences.

    Forward push: a node keeps ``restart`` of its residual and hands the rest along its
    edges, and to the seeds if it has none.  A query's nodes push while their residual
    is above its part of the tolerance, so only what a query reaches is ever touched.
    What is left unpushed is the greatest error.  Equal edges keep the greatest weight;
    seeds without weight above zero count for nothing.
    """
    e = edges.where("weight > 0").groupBy("from_id", "to_id", "relation").agg(F.max("weight").alias("weight")).groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("from_id").agg(F.sum("weight").alias("total"))
    share = cut(e.join(out, "from_id").select("from_id", "to_id", (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.where("weight > 0").groupBy("query_id", F.col("seed").alias("node")).agg(F.sum("weight").alias("w"))
    total = start.groupBy("query_id").agg(F.sum("w").alias("total"))
    start = cut(start.join(total, "query_id").select("query_id", "node", (F.col("w") / F.col("total")).alias("s")))
    sources = share.select(F.col("from_id").alias("node")).distinct()
    state = cut(start.select("query_id", "node", F.lit(0.0).alias("p"), F.col("s").alias("r")))
    for _ in range(most):
        bound = state.where("r > 0").groupBy("query_id").agg((F.lit(tolerance) / F.count("*")).alias("bound"))
        met = cut(state.join(bound, "query_id", "left").withColumn("active", F.coalesce(F.col("r") > F.col("bound"), F.lit(False))).drop("bound"))
        pushed = met.where("active").select("query_id", "node", ((1 - restart) * F.col("r")).alias("flow"))
        if pushed.isEmpty():
            return state.where("p > 0").select("query_id", "node", F.col("p").alias("score"))
        along = pushed.join(share, pushed.node == share.from_id).select("query_id", F.col("to_id").alias("node"), (F.col("flow") * F.col("share")).alias("r"))
        back = pushed.join(sources, "node", "left_anti").groupBy("query_id").agg(F.sum("flow").alias("flow")).join(start, "query_id").select("query_id", "node", (F.col("flow") * F.col("s")).alias("r"))
        kept = met.select("query_id", "node", F.when(F.col("active"), F.col("p") + restart * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("active"), 0.0).otherwise(F.col("r")).alias("r"))
        got = along.unionByName(back).select("query_id", "node", F.lit(0.0).alias("p"), "r")
        state = cut(kept.unionByName(got).groupBy("query_id", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r")))
    raise RuntimeError(f"residuals aren't below {tolerance} after {most} rounds")


#: Gains below this are none: sums of weights differ by their order.
TINY = 1e-9


def _wishes(state: DataFrame, links: DataFrame, resolution: float, turn: int, tag: str) -> DataFrame:
    """(node, size, own, to, gain, own_key, to_key): the best other group of each node
    that gains by it, or a group of its own if leaving alone gains more.

    Keys order groups by size and a hash that changes with ``turn``.
    """
    sizes = state.groupBy("group").agg(F.sum("size").alias("held"))
    sizes = sizes.withColumn("key", F.struct("held", F.xxhash64("group", F.lit(turn)).alias("h")))
    own = state.select("node", "size", F.col("group").alias("own"))
    near = links.join(state.select(F.col("node").alias("dst"), "group"), "dst").groupBy(F.col("src").alias("node"), "group").agg(F.sum("weight").alias("weight"))
    met = near.join(own, "node").join(sizes, "group")
    worth = F.col("weight") - resolution * F.col("size") * (F.col("held") - F.when(F.col("group") == F.col("own"), F.col("size")).otherwise(0))
    other = F.col("group") != F.col("own")
    met = met.withColumn("worth", F.round(worth, 9))
    best = met.groupBy("node").agg(F.max(F.when(other, F.struct("worth", "key", "group"))).alias("best"), F.max(F.when(~other, F.col("worth"))).alias("stay"))
    held = own.join(sizes.select(F.col("group").alias("own"), F.col("held"), F.col("key").alias("own_key")), "own").join(best, "node", "left")
    stay = F.coalesce("stay", F.round(-resolution * F.col("size") * (F.col("held") - F.col("size")), 9))
    alone = F.struct(F.lit(0.0).alias("worth"), F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("h")).alias("key"), F.concat("node", F.lit(f"~{tag}{turn}")).alias("group"))
    to = F.when(F.coalesce(F.col("best.worth") >= 0, F.lit(False)), F.col("best")).otherwise(alone)
    held = held.select("node", "size", "own", "own_key", stay.alias("stay"), to.alias("to"))
    return held.select("node", "size", "own", "own_key", F.col("to.group").alias("to"), F.col("to.key").alias("to_key"), (F.col("to.worth") - F.col("stay")).alias("gain")).where(F.col("gain") > TINY)


def _agreed(wish: DataFrame, links: DataFrame, resolution: float, turn: int, up: bool) -> DataFrame:
    """(node, to): wishes that are granted together; their joint gain is above zero.

    A group's nodes go to one other group, to those with greater keys (``up``) or lesser
    ones, and no group that nodes leave takes any in, so gains add up over groups that
    take nodes in.  For one such group nested random halves of the nodes that wish for
    it are weighed, pairs that meet or part included, and the best set is taken; the
    node with the highest gain alone is always one of them.  All of it is sums by
    group, so a group that all nodes wish for is no single task's.
    """
    agreed = wish.groupBy("own", "to").agg(F.sum("gain").alias("gain")).groupBy("own").agg(F.max(F.struct("gain", "to")).alias("best"))
    movers = wish.join(agreed.select("own", F.col("best.to").alias("to")), ["own", "to"])
    movers = movers.where(F.col("to_key") > F.col("own_key") if up else F.col("to_key") < F.col("own_key"))
    leaving = movers.select(F.col("own").alias("to")).distinct()
    half = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    movers = kept_apart(movers.join(leaving, "to", "left_anti").select("node", "size", "own", "to", "gain", F.floor(-F.log2(half)).cast("int").alias("level")))
    each = lambda level: F.explode(F.sequence(F.lit(0), level)).alias("k")
    side = lambda name: movers.select(F.col("node").alias(name), F.col("to").alias("to_" + name), F.col("own").alias("own_" + name), F.col("level").alias("level_" + name))
    pairs = links.where("src < dst").join(side("src"), "src").join(side("dst"), "dst").where("to_src = to_dst")
    pairs = pairs.select(F.col("to_src").alias("to"), "own_src", (F.col("own_src") == F.col("own_dst")).alias("parted"), "weight", each(F.least("level_src", "level_dst")))
    joined = pairs.groupBy("to", "k").agg(F.sum("weight").alias("joined"))
    parted = pairs.where("parted").groupBy("to", F.col("own_src").alias("own"), "k").agg(F.sum("weight").alias("parted"))
    penalty = lambda total, squares: resolution * (total * total - squares) / 2
    per = movers.select("to", "own", "size", "gain", each(F.col("level"))).groupBy("to", "own", "k").agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"), F.sum("gain").alias("gain"))
    per = per.join(parted, ["to", "own", "k"], "left")
    left = F.coalesce("parted", F.lit(0.0)) - penalty(F.col("s"), F.col("q"))
    sets = per.groupBy("to", "k").agg(F.sum(F.col("gain") + left).alias("gain"), F.sum("s").alias("s"), F.sum("q").alias("q")).join(joined, ["to", "k"], "left")
    joint = F.col("gain") + F.coalesce("joined", F.lit(0.0)) - penalty(F.col("s"), F.col("q"))
    best = sets.groupBy("to").agg(F.max(F.struct(F.round(joint, 9).alias("gain"), (-F.col("k")).alias("k"))).alias("set"))
    first = movers.groupBy("to").agg(F.max(F.struct("gain", "node")).alias("first"))
    chosen = best.join(first, "to").select("to", (F.col("set.gain") > F.col("first.gain")).alias("many"), (-F.col("set.k")).alias("k"), F.col("first.node").alias("first"))
    return movers.join(chosen, "to").where(F.when(F.col("many"), F.col("level") >= F.col("k")).otherwise(F.col("node") == F.col("first"))).select("node", "to")


def _moved(state: DataFrame, links: DataFrame, resolution: float, most: int = 1000) -> tuple[DataFrame, bool]:
    """(node, size, group) when no node gains by moving, under the constant Potts model,
    and whether any did move.

    ``state``: groups to start from; ``links``: (src, dst, weight), both ways, no loops.
    Every round's moves raise the quality, so it ends.
    """
    state, tag = kept_apart(state), uuid.uuid4().hex[:8]  # a group that a node begins has a name of its own
    for turn in range(most):
        wish = kept_apart(_wishes(state, links, resolution, turn, tag))
        if wish.isEmpty():
            return state, turn > 0
        go = _agreed(wish, links, resolution, turn, up=turn % 2 == 0)
        state = kept_apart(state.join(go, "node", "left").select("node", "size", F.coalesce("to", "group").alias("group")))
    raise RuntimeError(f"groups aren't settled after {most} rounds")


def _inside(state: DataFrame, links: DataFrame) -> DataFrame:
    """The links within a group."""
    named = lambda side: state.select(F.col("node").alias(side), F.col("group").alias("g_" + side))
    return links.join(named("src"), "src").join(named("dst"), "dst").where("g_src = g_dst").select("src", "dst", "weight")


def _refined(state: DataFrame, links: DataFrame, resolution: float) -> DataFrame:
    """(node, part): well-connected parts of groups.  Nodes that their group holds by at
    least the expected weight start alone and move within the group; parts that come
    apart are split."""
    inner = kept_apart(_inside(state, links))
    held = state.groupBy("group").agg(F.sum("size").alias("held"))
    weight = inner.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("weight"))
    firm = state.join(held, "group").join(weight, "node").where(F.col("weight") >= resolution * F.col("size") * (F.col("held") - F.col("size")) - TINY)
    ends = firm.select(F.col("node").alias("end"))
    kept = kept_apart(inner.join(ends, inner.src == ends.end, "left_semi").join(ends.withColumnRenamed("end", "other"), F.col("dst") == F.col("other"), "left_semi"))
    settled, _ = _moved(state.select("node", "size", F.col("node").alias("group")), kept, resolution)
    joined = _inside(settled, kept).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit("").alias("relation"), "weight")
    parts = connected_components(joined)
    return kept_apart(state.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part")))


def _merged(state: DataFrame, links: DataFrame, parts: DataFrame, resolution: float, together: bool) -> tuple[DataFrame, bool]:
    """``state`` after moves of whole parts (node, part), which start in their groups
    (``together``) or each alone, and whether any moved."""
    held = state.join(parts, "node")
    home = F.min("group") if together else F.first("part")
    nodes = held.groupBy(F.col("part").alias("node")).agg(F.sum("size").alias("size"), home.alias("group"))
    of = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias("p_" + side))
    between = links.join(of("src"), "src").join(of("dst"), "dst").where("p_src <> p_dst").groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    after, changed = _moved(nodes, kept_apart(between), resolution)
    if not changed:
        return state, False
    return kept_apart(held.drop("group").join(after.select(F.col("node").alias("part"), "group"), "part").select("node", "size", "group")), True


def sound(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, relation, weight), as strings, of edges that count in communities:
    between two nodes, of ``nodes`` if they are given, with a weight above zero.  An edge
    without a finite weight weighs 1."""
    relation = F.coalesce(F.col("relation"), F.lit("")) if "relation" in edges.columns else F.lit("")
    weight = F.col("weight").cast("double")
    weight = F.when(weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf")), 1.0).otherwise(weight)
    out = edges.select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), relation.alias("relation"), weight.alias("weight")).where("weight > 0 and from_id <> to_id")
    if nodes is not None:
        known = nodes.select(F.col("node").cast("string").alias("known"))
        for end in ("from_id", "to_id"):
            out = out.join(known, out[end] == known.known, "left_semi")
    return out


def communities(edges: DataFrame, resolution: float = 0.5, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community), as strings, of undirected edges (from_id, to_id, weight), by
    Leiden's scheme.

    Until nothing changes: nodes move; groups are refined to well-connected parts, which
    move as wholes from their groups; groups move as wholes, so they merge.  At the
    end no move of a node, of a part or of a group raises the quality under the constant
    Potts model.  All of it runs on tables; no scope or group is held by one task.  A
    community is named after its least node.  Loops and weights that aren't above zero
    count for nothing, see sound(); a node without other edges is its own community.
    Rows (node) of ``nodes`` are the graph's nodes, or else the ends of edges.
    """
    links = kept_apart(oriented(sound(edges, nodes)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    ends = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")) if nodes is None else nodes.select("node")
    ends = ends.select(F.col("node").cast("string").alias("node")).where("node is not null").distinct()
    state = kept_apart(ends.select("node", F.lit(1).cast("long").alias("size"), F.col("node").alias("group")))
    changed = True
    while changed:
        state, _ = _moved(state, links, resolution)
        state, parted = _merged(state, links, _refined(state, links, resolution), resolution, together=True)
        state, merged = _merged(state, links, kept_apart(state.select("node", F.col("group").alias("part"))), resolution, together=False)
        changed = parted or merged
    named = state.groupBy("group").agg(F.min("node").alias("community"))
    return state.join(named, "group").select("node", "community")


def community_quality(edges: DataFrame, groups: DataFrame, resolution: float = 0.5) -> DataFrame:
    """(community, size, inside, quality) of a partition (node, community) under the
    constant Potts model: inner weight less ``resolution`` per pair of members."""
    named = lambda side: groups.select(F.col("node").alias(side), F.col("community").alias("c_" + side))
    inner = edges.join(named("from_id"), "from_id").join(named("to_id"), "to_id").where("c_from_id = c_to_id and from_id <> to_id").groupBy(F.col("c_from_id").alias("community")).agg(F.sum("weight").alias("inside"))
    sizes = groups.groupBy("community").agg(F.count("*").alias("size"))
    met = sizes.join(inner, "community", "left")
    inside = F.coalesce("inside", F.lit(0.0))
    return met.select("community", "size", F.round(inside, 6).alias("inside"), F.round(inside - resolution * F.col("size") * (F.col("size") - 1) / 2, 6).alias("quality"))


def memberships(edges: DataFrame, groups: DataFrame, resolution: float = 0.5, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community, community_key, size, inside, quality, support_edges): a partition
    (node, community) as a whole, one row per node.

    The key is a digest of the sorted members, so equal communities have equal keys
    whenever they are built.  ``support_edges``: the inner edges that begin at the
    node, as from|relation|to.  For its key a community's members are one group: it has no
    more of them than a member's weight of edges over ``resolution``, and one.
    """
    groups = cut(groups)
    edges = sound(edges, nodes)
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256), 1, 20)
    keys = groups.groupBy("community").agg(F.concat(F.lit("community:"), digest).alias("community_key"))
    other = groups.select(F.col("node").alias("to_id"), F.col("community").alias("other"))
    ends = groups.select(F.col("node").alias("from_id"), "community")
    inner = edges.join(ends, "from_id").join(other, "to_id").where("community = other")
    ids = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "from_id", "relation", "to_id"))), ",")
    support = inner.groupBy(F.col("from_id").alias("node")).agg(ids.alias("support_edges"))
    met = groups.join(keys, "community").join(community_quality(edges, groups, resolution), "community").join(support, "node", "left")
    return met.select("node", "community", "community_key", "size", "inside", "quality", F.coalesce("support_edges", F.lit("")).alias("support_edges"))
