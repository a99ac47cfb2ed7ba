"""Evaluation: run comparison, arms, tools, packets, merged variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation
from ..operators import retrieval as op
from ..sources import bind
from . import analytics, chunks, retrieval

#: Metrics that are compared; all are better if higher.
METRICS = ["mean_recall", "mrr", "mean_ndcg", "pass_rate"]
BASELINE, CANDIDATE = "exact+lexical", "full-hybrid-rrf"


def run_comparison(spark, d):
    """Each metric of two runs side by side, and how far the candidate is ahead."""
    runs = analytics.runs_of(spark, d, (BASELINE, CANDIDATE))
    long = runs.select("configuration", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")).select("configuration", "m.metric", "m.value")
    of = lambda name: F.max(F.when(F.col("configuration") == name, F.col("value")))
    met = long.groupBy("metric").agg(of(BASELINE).alias("baseline"), of(CANDIDATE).alias("candidate"))
    return met.select("metric", "baseline", "candidate", F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"))


def _replies(spark, d):
    """(conv_id, turn, arm, recall): how many of a question's longer words its answer holds."""
    c = bind.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("asked")).where("role = 'assistant' and asked is not null")
    need = F.array_distinct(F.filter(text.tokens(F.col("asked")), lambda t: F.length(t) >= 5))
    have = F.array_distinct(text.tokens(F.col("text")))
    n, met = F.size(need), F.size(F.array_intersect(need, have))
    return rows.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B").alias("arm"), F.when(n == 0, 1.0).otherwise(met / n).alias("recall"), text.token_estimate(F.col("text")).alias("tokens"))


def ab_scores(spark, d):
    return _replies(spark, d).select("conv_id", "turn", "arm", F.round("recall", 6).alias("recall"), (F.col("recall") == 1).alias("correct"))


def ab_arms(spark, d):
    """Means of each arm."""
    r = _replies(spark, d)
    return r.groupBy("arm").agg(F.count("*").alias("tasks"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg((F.col("recall") == 1).cast("double")), 6).alias("correctness"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def tool_selection(spark, d):
    """Return flags of an order's first two lines as expected tools, of the later ones as used."""
    line = bind.table(spark, d, "lineitem")
    some = lambda test: F.collect_set(F.when(test, F.col("l_returnflag")))
    rows = line.groupBy(F.col("l_orderkey").alias("case_id")).agg(some(F.col("l_linenumber") <= 2).alias("expected"), some(F.col("l_linenumber") > 2).alias("used"))
    return evaluation.tool_selection(rows)


def packet_benchmark(spark, d):
    """Latencies of repeated packets of a kind, and whether they were all alike."""
    e = bind.table(spark, d, "events")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.min("value").alias("minimum"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("maximum"), (F.count_distinct("props") == 1).alias("stable"))


def merge_variants(spark, d):
    """Vector hits of a query and of its neighbour, as two variants of one query."""
    v = retrieval.vector_channel(spark, d)
    rows = v.select((F.col("query_id") - F.col("query_id") % 2).alias("query_id"), "doc_id", "score", (F.col("query_id") % 2).alias("variant"))
    return op.merge_variants(rows)


QUERIES = {f.__name__: f for f in (run_comparison, ab_scores, ab_arms, tool_selection, packet_benchmark, merge_variants)}

REPLIES = r"""replies as (select *, list_distinct(list_filter(regexp_extract_all(lower(asked), '[\p{L}\p{N}]+'), lambda t: length(t) >= 5)) as need, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as have from (select *, lag(text) over (partition by conv_id order by turn) as asked from conversations) where role = 'assistant' and asked is not null),
rs as (select conv_id, turn, case when conv_id % 2 = 0 then 'A' else 'B' end as arm, case when len(need) = 0 then 1.0::double else len(list_intersect(need, have)) / len(need)::double end as recall, ceil(length(text) / 4.0) as tokens from replies)"""

SQL = {
    "run_comparison": f"""with recursive {analytics.RUN}, l as (select configuration, unnest(['mean_recall', 'mrr', 'mean_ndcg', 'pass_rate']) as metric, unnest([mean_recall, mrr, mean_ndcg, pass_rate]) as value from agg where configuration in ('{BASELINE}', '{CANDIDATE}')),
      m as (select metric, max(value) filter (configuration = '{BASELINE}') as baseline, max(value) filter (configuration = '{CANDIDATE}') as candidate from l group by 1) select metric, baseline, candidate, round(candidate - baseline, 6) as delta from m""",
    "ab_scores": f"with {REPLIES} select conv_id, turn, arm, round(recall, 6) as recall, recall = 1 as correct from rs",
    "ab_arms": f"with {REPLIES} select arm, count(*) as tasks, round(avg(recall), 6) as mean_recall, round(avg((recall = 1)::int), 6) as correctness, round(avg(tokens), 6) as mean_tokens from rs group by 1",
    "tool_selection": """with t as (select l_orderkey as case_id, coalesce(list(distinct l_returnflag) filter (l_linenumber <= 2), []) as e, coalesce(list(distinct l_returnflag) filter (l_linenumber > 2), []) as u from lineitem group by 1),
      c as (select case_id, len(u) - len(list_intersect(u, e)) as unexpected, len(e) - len(list_intersect(e, u)) as missing from t) select case_id, unexpected, missing, unexpected = 0 and missing = 0 as exact from c""",
    "packet_benchmark": "select event_type, count(*) as runs, min(value) as minimum, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as maximum, count(distinct props) = 1 as stable from events group by 1",
    "merge_variants": f"""with recursive {retrieval.GOVERNED}, {chunks.PLAIN_UNITS}, {retrieval.VECTOR}, v as (select query_id - query_id % 2 as query_id, doc_id, score, query_id % 2 as variant from vector)
      select query_id, doc_id, score, variant from (select *, row_number() over (partition by query_id, doc_id order by score desc, variant) as n from v) where n = 1""",
}
