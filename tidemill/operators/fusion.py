"""Reciprocal rank fusion of ranked lists, highlights, reranking and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import nearest, values_at
from .search import top_k


def fuse(left: DataFrame, right: DataFrame, k: int = 60, w1: float = 1.0, w2: float = 1.0, names: tuple[str, str] = ("bm25", "vector")) -> DataFrame:
    """Fuses (query_id, chunk_id, rank from 1, score) lists; a missing rank counts as k.

    score = w1 / (k + r1) + w2 / (k + r2) with ranks from 0.  Ties go by chunk_id.
    """
    a = left.select("query_id", "chunk_id", (F.col("rank") - 1).alias("r1"), F.col("score").alias("s1"))
    b = right.select("query_id", "chunk_id", (F.col("rank") - 1).alias("r2"), F.col("score").alias("s2"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = w1 / (k + F.coalesce("r1", F.lit(k))) + w2 / (k + F.coalesce("r2", F.lit(k)))
    return both.select(
        "query_id",
        "chunk_id",
        score.alias("fused_score"),
        F.array_compact(F.array(F.when(F.col("r1").isNotNull(), names[0]), F.when(F.col("r2").isNotNull(), names[1]))).alias("sources"),
        F.coalesce("s1", F.lit(0.0)).alias(f"{names[0]}_score"),
        F.coalesce("s2", F.lit(0.0)).alias(f"{names[1]}_score"),
    )


def fused_top(left: DataFrame, right: DataFrame, n: int, **options) -> DataFrame:
    return top_k(fuse(left, right, **options), "query_id", [F.round("fused_score", 12).desc(), F.col("chunk_id")], n)


def merge_highlights(a: Column, b: Column) -> Column:
    """The first three different fragments of both."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))), 1, 3)


def document_text(subject: Column, content: Column, sender: Column) -> Column:
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" | ", part("Subject", subject), part("Content", F.substring(content, 1, 500)), part("From", sender))


def rerank(fused: DataFrame, scorer: Column, limit: int = 100) -> DataFrame:
    """The first ``limit`` of each query by a scorer; final = .7 fused + .3 scorer, in the scorer's order."""
    top = top_k(fused.drop("rank"), "query_id", [F.round("fused_score", 12).desc(), F.col("chunk_id")], limit).drop("rank")
    scored = top.withColumn("rerank_score", scorer).withColumn("final_score", 0.7 * F.col("fused_score") + 0.3 * F.col("rerank_score"))
    return top_k(scored, "query_id", [F.col("rerank_score").desc(), F.col("chunk_id")], limit)


def performance(times: DataFrame, group: list[str], col: str) -> DataFrame:
    """Number, mean, nearest-rank 95th percentile, maximum and a grade of search times in seconds."""
    g = times.groupBy(*group).agg(F.count("*").alias("n"), F.avg(col).alias("avg_time"), F.max(col).alias("max_time"))
    ranked = values_at(times, group, col, {"p95": nearest(0.95)})
    same = F.lit(True)
    for c in group:
        same &= F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}"))
    grade = F.when(F.col("avg_time") < 0.1, "excellent").when(F.col("avg_time") < 0.5, "good").when(F.col("avg_time") < 1.0, "fair").otherwise("poor")
    out = g.alias("g").join(ranked.alias("r"), same, "left")
    return out.select(*[F.col(f"g.{c}") for c in group], "g.n", "avg_time", F.coalesce("p95", F.lit(0.0)).alias("p95"), "max_time", grade.alias("grade"))
