"""Search and ingestion metrics by tenant and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import hit_at, ndcg_linear, precision_recall_f1, reciprocal_rank
from .ranks import exclusive, linear, nearest, values_at

# Lengths of the time windows in hours; anything else is a day.
WINDOWS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
# Least acceptable quality.
THRESHOLDS = {"hit_at_5": 0.65, "mrr_at_10": 0.55, "ndcg_at_10": 0.60}


def within(logs: DataFrame, ts: str, now: str, window: str) -> DataFrame:
    return logs.where(F.col(ts) >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {WINDOWS.get(window, 24)} HOURS"))


def score_lists(rows: DataFrame, query: list[str], order: str, score: str) -> DataFrame:
    """Scores of each query as an array in rank order."""
    lists = rows.groupBy(*query).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s")))).alias("l"))
    return lists.select(*query, F.transform("l", lambda x: x["s"]).alias("scores"))


def quality(lists: DataFrame, query: list[str]) -> DataFrame:
    """hit@k, reciprocal rank, linear gain at 10, precision, recall and F1 for k in 1, 3, 5, 10 (null if fewer results)."""
    s = F.col("scores")
    cols = [hit_at(s, k).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)] + [reciprocal_rank(s).alias("mrr"), ndcg_linear(s, 10).alias("ndcg")]
    for k in (1, 3, 5, 10):
        for name, c in zip(("precision", "recall", "f1"), precision_recall_f1(s, k)):
            cols.append(F.when(F.size(s) >= k, c).alias(f"{name}_at_{k}"))
    return lists.select(*query, *cols)


def assess(measured: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Which thresholds are met, and warnings."""
    t = {**THRESHOLDS, **(thresholds or {})}
    ok = {"hit_at_5": F.col("hit_at_5") >= t["hit_at_5"], "mrr_at_10": F.col("mrr") >= t["mrr_at_10"], "ndcg_at_10": F.col("ndcg") >= t["ndcg_at_10"]}
    out = measured.withColumns({f"{n}_met": c for n, c in ok.items()})
    every = ok["hit_at_5"] & ok["mrr_at_10"] & ok["ndcg_at_10"]
    warn = F.array_compact(F.array(F.when(~ok["hit_at_5"], "hit_at_5"), F.when(~ok["mrr_at_10"], "mrr_at_10"), F.when(~ok["ndcg_at_10"], "ndcg_at_10")))
    return out.withColumn("overall_pass", every).withColumn("below", warn)


def quality_summary(measured: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Means, share of met thresholds, and a status: .8 healthy, .6 warning, else critical."""
    t = {**THRESHOLDS, **(thresholds or {})}
    m = measured.agg(F.count("*").alias("queries"), F.avg("hit_at_5").alias("hit_at_5"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    met = [(F.col("hit_at_5") >= t["hit_at_5"]), (F.col("mrr") >= t["mrr_at_10"]), (F.col("ndcg") >= t["ndcg_at_10"])]
    m = m.withColumn("compliance", (met[0].cast("int") + met[1].cast("int") + met[2].cast("int")) / 3.0)
    return m.withColumn("status", F.when(F.col("compliance") >= 0.8, "healthy").when(F.col("compliance") >= 0.6, "warning").otherwise("critical"))


def run_benchmark(queries: DataFrame, measured: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Totals over validated queries (query_id, is_valid) and their measures: passed, failed, means, compliance.

    A query fails when it is invalid or returned nothing; one that returned hits but
    missed a threshold counts as neither.
    """
    t = {**THRESHOLDS, **(thresholds or {})}
    q = queries.join(assess(measured, t), "query_id", "left")
    answered = F.col("is_valid") & F.col("hit_at_5").isNotNull()
    out = q.agg(
        F.count("*").alias("total"),
        F.count_if(answered & F.col("overall_pass")).alias("passed"),
        F.count_if(~answered).alias("failed"),
        *[F.round(F.coalesce(F.avg(F.when(answered, F.col(c))), F.lit(0.0)), 3).alias(f"avg_{c}") for c in ("hit_at_5", "mrr", "ndcg")],
    )
    return out.withColumns({f"compliance_{c}": F.col(f"avg_{c}") / t[k] for c, k in (("hit_at_5", "hit_at_5"), ("mrr", "mrr_at_10"), ("ndcg", "ndcg_at_10"))})


def performance_summary(logs: DataFrame, group: list[str], ms: str = "total_time_ms", success: str = "success") -> DataFrame:
    """Searches by outcome; mean and exclusive 95th and 99th percentiles of successful times (0 below 20 and 100 values)."""
    good = F.when(F.col(success), F.col(ms))
    g = logs.groupBy(*group).agg(
        F.count("*").alias("total_searches"),
        F.count_if(F.col(success)).alias("successful_searches"),
        F.count_if(~F.col(success)).alias("failed_searches"),
        F.avg(good).alias("m"),
    )
    ranked = values_at(logs.select(*group, good.alias("_v")), group, "_v", {"p95_ms": exclusive(20, 19), "p99_ms": exclusive(100, 99)})
    out = g.alias("g").join(ranked.alias("r"), _same(group), "left")
    return out.select(*[F.col(f"g.{c}") for c in [*group, "total_searches", "successful_searches", "failed_searches"]], F.coalesce("m", F.lit(0.0)).alias("avg_time_ms"), *[F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in ("p95_ms", "p99_ms")])


def window_summary(logs: DataFrame, group: list[str], now: str, window: str = "24h", ts: str = "timestamp", components: tuple[str, ...] = ("bm25_time_ms", "vector_time_ms", "fusion_time_ms"), kind: str = "search_type", error: str = "error_message") -> DataFrame:
    """The summary of a time window before ``now``: outcomes and percentiles, mean component times, counts by type and by error.

    A component counts where a search succeeded and it took any time; 0 if there is
    none.  A failed search without a message is in no error count.
    """
    logs = within(logs, ts, now, window)
    spent = [F.coalesce(F.avg(F.when(F.col("success") & (F.col(c) > 0), F.col(c))), F.lit(0.0)).alias(f"avg_{c}") for c in components]
    out = performance_summary(logs, group).alias("g").join(logs.groupBy(*group).agg(*spent).alias("r"), _same(group)).select("g.*", *[f"r.avg_{c}" for c in components])
    failed = logs.where(~F.col("success") & (F.length(error) > 0))
    for name, rows, col in (("search_types", logs, kind), ("errors", failed, error)):
        counts = distribution_map(rows, group, col).withColumnRenamed("counts", name)
        out = out.alias("g").join(counts.alias("r"), _same(group), "left").select("g.*", f"r.{name}")
    return out


def export_searches(logs: DataFrame, group: list[str], ts: str = "timestamp", n: int = 100, chars: int = 100) -> DataFrame:
    """The newest ``n`` searches of each group, queries cut to ``chars`` characters."""
    w = Window.partitionBy(*group).orderBy(F.desc(ts), F.desc("query_id"))
    newest = logs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return newest.select(*group, "query_id", F.substring("query", 1, chars).alias("query"), ts, "total_time_ms", "search_type", "success")


def quality_averages(measured: DataFrame, group: list[str], measures: tuple[str, ...] = ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr", "ndcg")) -> DataFrame:
    """Means of the quality measures over all time, and of how many queries."""
    return measured.groupBy(*group).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in measures])


def _same(group: list[str]) -> Column:
    out = F.lit(True)
    for c in group:
        out &= F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def global_metrics(summary: DataFrame) -> DataFrame:
    """Totals over tenants, and the plain mean of the tenants' rounded means."""
    return summary.agg(
        F.count("*").alias("tenants"),
        F.sum("total_searches").alias("total_searches"),
        F.sum("successful_searches").alias("successful_searches"),
        F.avg(F.round("avg_time_ms", 2)).alias("avg_time_ms"),
    )


def distribution(logs: DataFrame, group: list[str], col: str, where: Column | None = None) -> DataFrame:
    rows = logs if where is None else logs.where(where)
    return rows.groupBy(*group, col).agg(F.count("*").alias("n"))


def distribution_map(logs: DataFrame, group: list[str], col: str) -> DataFrame:
    counts = distribution(logs, group, col)
    return counts.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(col), F.col("n"))))).alias("counts"))


def batch_metrics(outcomes: DataFrame, batch: str = "batch_id") -> DataFrame:
    """By batch over outcome rows (kind, reason, seconds): totals, rates and mean time."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = outcomes.groupBy(batch).agg(
        n("processed").alias("processed"), n("failed").alias("failed"), n("quarantined").alias("quarantined"), n("duplicate").alias("duplicates"),
        F.avg(F.when(F.col("kind") == "processed", F.col("seconds"))).alias("avg_seconds"), F.sum("seconds").alias("total_seconds"),
    )
    done = F.col("processed") + F.col("failed") + F.col("quarantined")
    repeats = F.col("duplicates") + F.col("processed")
    return (
        g.withColumn("docs_total", done + F.col("duplicates"))
        .withColumn("error_count", F.col("failed") + F.col("quarantined"))
        .withColumn("success_rate", F.when(done > 0, F.col("processed") / done).otherwise(0.0))
        .withColumn("dedup_ratio", F.when(repeats > 0, F.col("duplicates") / repeats).otherwise(0.0))
        .withColumn("docs_per_second", F.when(F.col("total_seconds") > 0, F.col("processed") / F.col("total_seconds")).otherwise(0.0))
    )


def error_buckets(outcomes: DataFrame, batch: str = "batch_id") -> DataFrame:
    name = F.when(F.col("kind") == "quarantined", F.concat(F.lit("quarantined_"), "reason")).when(F.col("kind") == "duplicate", F.concat(F.lit("duplicate_"), "reason")).otherwise(F.col("reason"))
    return outcomes.where("kind <> 'processed'").groupBy(batch, name.alias("bucket")).agg(F.count("*").alias("n"))


def progress(batches: DataFrame) -> DataFrame:
    """Progress in percent, rows a second and seconds left."""
    left = F.col("total") - F.col("done")
    rate = F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed")).otherwise(0.0)
    return batches.select("*", F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(0.0).alias("percent"), rate.alias("rate"), F.when(rate > 0, left / rate).alias("eta"))


def ocr_latency_p95(times: DataFrame, group: list[str], col: str) -> DataFrame:
    groups = times.select(*group).distinct()
    out = groups.alias("g").join(values_at(times, group, col, {"p95": nearest(0.95)}).alias("r"), _same(group), "left")
    return out.select(*[F.col(f"g.{c}") for c in group], F.coalesce("p95", F.lit(0.0)).alias("p95"))


def linear_p95(times: DataFrame, group: list[str], col: str) -> DataFrame:
    groups = times.select(*group).distinct()
    out = groups.alias("g").join(values_at(times, group, col, {"p95": linear(0.95)}).alias("r"), _same(group), "left")
    return out.select(*[F.col(f"g.{c}") for c in group], "p95")


def long_format(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows metric, value of all numeric columns."""
    cols = [c for c in summary.columns if c not in keys]
    return summary.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "metric", "value")


def step_metrics(events: DataFrame, group: list[str]) -> DataFrame:
    """By step: runs, mean and nearest-rank 95th percentile of durations, success rate."""
    g = events.groupBy(*group).agg(F.count("*").alias("runs"), F.avg("duration_ms").alias("avg_ms"), F.avg(F.col("ok").cast("double")).alias("success_rate"))
    ranked = values_at(events.where("duration_ms > 0"), group, "duration_ms", {"p95_ms": nearest(0.95)})
    out = g.alias("g").join(ranked.alias("r"), _same(group), "left")
    return out.select(*[F.col(f"g.{c}") for c in [*group, "runs", "avg_ms"]], F.coalesce("p95_ms", F.lit(0.0)).alias("p95_ms"), "g.success_rate")


def pair_steps(marks: DataFrame) -> DataFrame:
    """Durations from start and end marks (workflow_id, step, mark, ts)."""
    g = marks.groupBy("workflow_id", "step").agg(F.min(F.when(F.col("mark") == "start", F.col("ts"))).alias("started"), F.max(F.when(F.col("mark") == "end", F.col("ts"))).alias("ended"))
    ms = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000.0
    return g.select("workflow_id", "step", ms.alias("duration_ms"), F.when(F.col("ended").isNull(), "running").otherwise("completed").alias("status"))
