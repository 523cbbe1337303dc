"""Normalization of a message body as one operator, with its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def normalize_content(rows: DataFrame, text: str, content_type: Column, charset: str = "utf-8") -> DataFrame:
    """Adds normalized_text, counts, hashes, language and the manifest to ``rows``.

    The way is chosen by the message's content type: HTML to its visible text,
    everything else as plain text; then signatures and quotes go.  stripped_blocks
    counts what is left to strip, which is nothing; removed_lines says how many
    lines of the cleaned text went.  The manifest only names columns, so what a
    query does not take of it (the language) is not worked out.
    """
    html = content_type == "text/html"
    cleaned = F.when(html, X.visible_text(F.col(text))).otherwise(X.normalize_plain(F.col(text)))
    out = rows.withColumn("_clean", cleaned).withColumn("normalized_text", X.strip_signature_and_quotes(F.col("_clean")))
    lines = lambda c: F.size(F.split(c, "\n"))
    norm = F.col("normalized_text")
    out = out.withColumns(
        {
            "raw_content_hash": F.sha2(F.col(text), 256),
            "normalized_text_hash": F.sha2(norm, 256),
            "content_length": F.length(text).cast("long"),
            "word_count": X.count_words(norm),
            "sentence_count": X.count_sentences(norm),
            "paragraph_count": X.count_paragraphs(norm),
            "detected_language": X.detect_language(norm),
            "language_confidence": F.lit(0.8),
            "removed_lines": (lines(F.col("_clean")) - lines(norm)).cast("long"),
            "_chars": F.length(norm).cast("long"),
            "_tokens": X.estimate_tokens(norm),
        }
    )
    steps = F.array(F.when(html, "html_to_text").otherwise("plain_text_cleanup"), F.lit("signature_stripping"), F.lit("quote_stripping"), F.lit("whitespace_normalization"))
    manifest = F.struct(
        F.lit("str").alias("input_type"),
        content_type.alias("content_type"),
        F.lit(charset).alias("charset"),
        F.col("detected_language"),
        F.lit(0).cast("long").alias("stripped_blocks"),
        F.col("detected_language").alias("lang"),
        F.col("_chars").alias("length_chars"),
        F.col("_tokens").alias("token_estimate"),
        steps.alias("normalization_steps"),
        F.current_timestamp().alias("timestamp"),
    )
    return out.withColumn("manifest", manifest).drop("_clean", "_chars", "_tokens")
