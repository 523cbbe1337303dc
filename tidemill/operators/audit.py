"""Audit traces of draft workflows: steps, patches, citations, and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import nearest, values_at


def mark_used(citations: DataFrame, used: DataFrame) -> DataFrame:
    """Citations with a flag: whether they are listed as used."""
    marks = used.select("workflow_id", "chunk_uid").distinct().withColumn("_used", F.lit(True))
    return citations.join(marks, ["workflow_id", "chunk_uid"], "left").withColumn("used", F.coalesce("_used", F.lit(False))).drop("_used")


def export_trace(steps: DataFrame, citations: DataFrame) -> DataFrame:
    """By workflow: steps, total and nearest-rank 95th percentile of positive durations, failures, used share of citations."""
    s = steps.groupBy("workflow_id").agg(F.count("*").alias("steps"), F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("status") == "failed").alias("failures"))
    p95 = values_at(steps.where("duration_ms > 0"), ["workflow_id"], "duration_ms", {"p95_ms": nearest(0.95)}).drop("n")
    c = citations.groupBy("workflow_id").agg(F.count("*").alias("citations"), F.count_if("used").alias("used"))
    out = s.join(p95, "workflow_id", "left").join(c, "workflow_id", "left")
    hit = F.when(F.coalesce("citations", F.lit(0)) > 0, F.col("used") / F.col("citations")).otherwise(0.0)
    return out.select("workflow_id", "steps", "total_ms", F.coalesce("p95_ms", F.lit(0.0)).alias("p95_ms"), "failures", hit.alias("retrieval_hit_k"))


def update_metrics(values: DataFrame) -> DataFrame:
    """The value of each metric: the mean of what was recorded under its name."""
    return values.groupBy("workflow_id", "metric").agg(F.avg("value").alias("value"))


def step_events(steps: DataFrame) -> DataFrame:
    """A start and a complete event for every step, in order."""
    e = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("start").alias("event")), F.struct(F.lit(1).alias("o"), F.lit("complete").alias("event"))))
    return steps.select("workflow_id", "position", "step", e.alias("e")).select("workflow_id", (F.col("position") * 2 + F.col("e.o")).alias("position"), "step", "e.event")
