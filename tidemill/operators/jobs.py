"""Embedding jobs: enqueueing, batching, providers, costs, and the hand-over of results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import ship
from .ranks import linear, values_at

STATUSES = ("pending", "processing", "completed", "failed")
BATCH_JOBS = 64
BATCH_SECONDS = 5.0


def enqueue(chunks: DataFrame, jobs: DataFrame, created_at: Column, priority: int = 0, max_retries: int = 3) -> DataFrame:
    """New pending jobs for chunks (tenant_id, chunk_id, email_id, content) that have none yet; the content travels with the job."""
    new = chunks.join(jobs.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return new.select(
        F.sha2(F.concat_ws(":", F.col("tenant_id").cast("string"), F.col("chunk_id").cast("string")), 256).alias("id"), "tenant_id", "chunk_id", "email_id",
        F.lit("pending").alias("status"), F.lit(priority).alias("priority"), F.lit(0).alias("retry_count"), F.lit(max_retries).alias("max_retries"), created_at.alias("created_at"), "content",
    )


def check_status(jobs: DataFrame) -> DataFrame:
    """Rows whose status is none of the allowed ones."""
    return jobs.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull())


def batch_numbers(jobs: DataFrame, by: list[str], size: int = BATCH_JOBS) -> DataFrame:
    """Number of the batch of each job, in order of priority and age."""
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), "created_at", "id")
    return jobs.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def batch_ready(waiting: Column, since_last: Column, size: int = BATCH_JOBS, seconds: float = BATCH_SECONDS) -> Column:
    return (waiting >= size) | ((waiting > 0) & (since_last >= seconds))


def cost_allowed(spent: Column, limit: Column, estimate: Column) -> Column:
    return spent + estimate <= limit


def batch_cost(texts: Column, rate: float = 0.0001) -> Column:
    """Cost of a batch by its number of texts: rate for a thousand quarters."""
    return rate * F.floor(texts / 4) / 1000.0


def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """A stand-in embedding: a unit vector drawn from the text's hash."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).normal(size=size)
    return (v / np.linalg.norm(v)).astype(np.float32)


#: Embedding providers by name; each turns a text into a vector.
PROVIDERS: dict[str, Callable[[str], np.ndarray]] = {"hashed": hashed_vector}


def embed(jobs: DataFrame, provider: str = "hashed", providers: dict[str, Callable[[str], np.ndarray]] | None = None) -> DataFrame:
    """Jobs with their embedding and new status; a text that fails counts a retry and fails alone."""
    ship(jobs.sparkSession)
    make = dict(providers or PROVIDERS)[provider]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            vectors, status, retries = [], [], []
            for text, n in zip(b.column("content").to_pylist(), b.column("retry_count").to_pylist()):
                try:
                    vectors.append(make(text or "").tolist())
                    status.append("completed")
                    retries.append(n)
                except Exception:  # one bad text
                    vectors.append(None)
                    status.append("failed")
                    retries.append((n or 0) + 1)
            keep = [c for c in b.schema.names if c not in ("content", "status", "retry_count")]
            yield pa.record_batch(
                [b.column(c) for c in keep] + [pa.array(status), pa.array(retries, pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, "status", "retry_count", "embedding"]
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in jobs.schema if f.name not in ("content", "status", "retry_count"))
    return jobs.mapInArrow(run, f"{kept}, status string, retry_count int, embedding array<float>")


def upsert_vectors(store: DataFrame, finished: DataFrame) -> DataFrame:
    """The store (chunk_id, embedding, created_at) with finished jobs' vectors; the newest of a chunk wins."""
    new = finished.where("status = 'completed'").select("chunk_id", "embedding", "created_at")
    both = store.select("chunk_id", "embedding", "created_at").unionByName(new)
    return both.groupBy("chunk_id").agg(F.max_by(F.struct("embedding", "created_at"), "created_at").alias("v")).select("chunk_id", "v.*")


def health(batches: DataFrame, group: list[str]) -> DataFrame:
    """Success rate, mean and linear 95th percentile of batch times, and a status."""
    g = batches.groupBy(*group).agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("ms").alias("avg_ms"))
    p95 = values_at(batches, group, "ms", {"p95_ms": linear(0.95)})
    same = F.lit(True)
    for c in group:
        same &= F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}"))
    g = g.alias("g").join(p95.alias("r"), same, "left").select("g.*", "r.p95_ms")
    return g.withColumn("status", F.when(F.col("success_rate") >= 0.95, "healthy").when(F.col("success_rate") >= 0.8, "degraded").otherwise("unhealthy"))
