"""Cutting texts into overlapping chunks of whole sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, collapse, count_blank_separated, strip


def sentences(c: Column) -> Column:
    """Sentences of a text; the end marks go, and a full stop is put on what does not end in one of ``.!?``."""
    parts = F.filter(F.transform(F.split(collapse(c), rf"[.!?]+{WS}+"), strip), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))


def chunk_texts(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<string>: sentences joined until the next would exceed ``size``; each chunk begins with the last ``overlap`` characters of the one before."""
    if not (100 <= size <= 10_000 and 0 <= overlap <= 1000):
        raise ValueError("chunk size is 100 to 10000, overlap 0 to 1000")
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (F.length(s["cur"]) + F.length(x) > size) & (F.length(s["cur"]) > 0)
        tail = F.substring(s["cur"], F.greatest(F.lit(1), F.length(s["cur"]) - overlap + 1), F.lit(overlap))
        return F.struct(
            F.when(full, F.concat(tail, x)).otherwise(F.concat(s["cur"], x)).alias("cur"),
            F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"),
        )

    done = lambda s: F.when(F.length(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])
    return F.aggregate(sentences(c), zero, step, done)


def respects_boundaries(c: Column) -> Column:
    """Begins with a capital, and ends a sentence or holds no open end mark."""
    return c.rlike(r"^\p{Lu}") & (c.rlike("[.!?]$") | ~c.rlike(rf"[.!?]{WS}*$"))


def create_chunks(texts: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, kind: str = "text") -> DataFrame:
    """One row per chunk with its index, hash, uid, token count and flags.

    ``true_start`` is where the chunk begins in the text's sentences, joined:
    behind what the chunks before it hold, less what it repeats of the last one.
    """
    whole = chunk_texts(F.coalesce(F.col(text_col), F.lit("")), size, overlap)
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        # the next chunk repeats the end of this one
        tail = F.least(F.length(x), F.lit(overlap))
        return F.struct((s["next"] + F.length(x) - tail).alias("next"), F.concat(s["starts"], F.array(s["next"])).alias("starts"))

    cut = texts.select(F.col(id_col), whole.alias("_c")).select(F.col(id_col), "_c", F.aggregate("_c", zero, step, lambda s: s["starts"]).alias("_s"))
    chunks = cut.select(F.col(id_col), F.posexplode(F.arrays_zip("_c", "_s")).alias("chunk_index", "_z")).select(id_col, "chunk_index", F.col("_z._c").alias("content"), F.col("_z._s").alias("true_start"))
    hashed = F.sha2(F.encode("content", "UTF-8"), 256)
    return chunks.select(
        id_col,
        "chunk_index",
        F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), F.substring(hashed, 1, 8)).alias("chunk_uid"),
        "content",
        hashed.alias("content_hash"),
        F.lit(0).alias("start_position"),
        F.length("content").alias("end_position"),
        count_blank_separated(F.col("content")).alias("token_count"),
        F.lit(kind).alias("chunk_type"),
        respects_boundaries(F.col("content")).alias("semantic_boundary"),
        "true_start",
    )


def chunk_stats(chunks: DataFrame, id_col: str) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct(id_col).alias("emails_with_chunks"),
        (F.count("*") / F.count_distinct(id_col)).alias("avg_chunks_per_email"),
        F.avg("token_count").alias("avg_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.min("token_count").alias("min_tokens"),
    )


def validate_chunks(chunks: DataFrame, id_col: str) -> DataFrame:
    """Errors of each text's chunks: a missing uid or content, no tokens, an inverted range."""
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce(F.length("chunk_uid"), F.lit(0)) == 0, "missing uid"),
            F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty content"),
            F.when(F.col("token_count") <= 0, "no tokens"),
            F.when(F.col("end_position") <= F.col("start_position"), "bad positions"),
        )
    )
    return chunks.withColumn("errors", errors).groupBy(id_col).agg(
        F.count("*").alias("chunks"), F.sum(F.size("errors")).alias("errors"), F.bool_and(F.size("errors") == 0).alias("all_valid")
    )


def chunks_of(chunks: DataFrame, **where) -> DataFrame:
    """Chunks by e-mail, attachment or uid."""
    for k, v in where.items():
        chunks = chunks.where(F.col(k) == v)
    return chunks


def without_chunks_of(chunks: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    return chunks.join(gone.select(id_col).distinct(), id_col, "left_anti")


def body_and_attachment_chunks(bodies: DataFrame, attachments: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of body texts (email_id, text) and of extracted attachment texts (email_id, text)."""
    usable = attachments.where(F.length(strip(F.col("text"))) > 0)
    return create_chunks(bodies, "email_id", "text", size, overlap).unionByName(create_chunks(usable, "email_id", "text", size, overlap, "attachment"))
