"""Progress of ingestion batches as a table, in place of one file per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress_of(outcomes: DataFrame, totals: DataFrame, at: Column) -> DataFrame:
    """A checkpoint row per batch from outcome rows (batch_id, path, kind): counts, last file, completeness."""
    g = outcomes.groupBy("batch_id").agg(
        F.count_if(F.col("kind") == "processed").alias("processed_emails"), F.count_if(F.col("kind") == "failed").alias("failed_emails"),
        F.count_if(F.col("kind") == "quarantined").alias("quarantined_emails"), F.max("path").alias("last_processed_email"), F.count("*").alias("seen"),
    )
    out = totals.join(g, "batch_id", "left").na.fill(0)
    return out.withColumn("is_complete", F.col("seen") >= F.col("total_emails")).withColumn("updated_at", at).drop("seen")


def remaining(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Files of a batch that no outcome mentions."""
    return manifest.join(outcomes.select("batch_id", "path").distinct(), ["batch_id", "path"], "left_anti")


def recent(checkpoints: DataFrame, n: int) -> DataFrame:
    return checkpoints.orderBy(F.desc("updated_at"), "batch_id").limit(n)


def cleanup(checkpoints: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Without complete batches older than ``days``."""
    return checkpoints.where(~F.col("is_complete") | (F.col("updated_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
