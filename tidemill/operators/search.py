"""Ranked retrieval for batches of queries: inverted index, BM25, vectors, text search, facets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import snippet, strip, words
from ..sources.work import cut, ship
from . import nearest

# The default English stop list of common text analyzers.
ANALYZER_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# What makes a query invalid, and words that say little.
DANGEROUS = ["javascript:", "data:", "vbscript:", "<script>", "eval(", "union select", "drop table", "delete from"]
WILDCARDS = ["*", "?", ".*", ".*.*"]
GENERIC = ["the", "and", "or", "but", "in", "on", "at", "to", "for"]
# Weights of the fields.
BOOSTS = {"subject": 2.0, "content": 1.0, "from_addr": 1.5, "to_addrs": 0.8}
#: Rows of the query side up to which it is broadcast, after counting.
QUERY_ROWS = 100_000
#: Bytes of query texts that go to the tasks together.
QUERY_BYTES = 16 << 20


def analyze(c: Column) -> Column:
    """Lower-case words without stop words."""
    return F.filter(words(F.lower(c)), lambda x: ~x.isin(ANALYZER_STOP_WORDS))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): a row for each different term of a document, with the document's length."""
    t = docs.select(F.col(id_col), analyze(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    t = t.select(id_col, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return t.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of documents with terms, and their mean length."""
    t = docs.select(F.size(analyze(F.coalesce(F.col(text_col), F.lit("")))).alias("dl"))
    return t.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def counted_terms(texts: DataFrame, keys: list[str], wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the wanted terms, their document frequencies, and numbers and mean lengths of documents, all from one reading of ``texts`` (keys, terms).

    (keys, dl, term, tf), (by, term, df), (by, n_docs, avgdl).  A text also holds the
    empty term, which no text has of itself, so that texts without wanted terms are
    counted.  The postings are written once: frequencies are joined to what they count.
    """
    every = texts.select(*keys, F.size("terms").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    asked = wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([("",)], "term string"))
    asked = F.broadcast(asked) if wanted.count() <= QUERY_ROWS else asked
    tf = cut(every.join(asked, "term", "left_semi").groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")), texts.sparkSession)
    stats = tf.where("term = ''").groupBy(*by).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    tf = tf.where("term <> ''")
    return tf, tf.groupBy(*by, "term").agg(F.count("*").alias("df")), stats


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_col: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k documents of every query: query_id, id, score, rank (from 1); ties by id.

    idf is ln(1 + (N - df + .5) / (df + .5)).  Query terms are the stated query set:
    they are broadcast when few, so postings of other terms are dropped before any
    shuffle.
    """
    q = queries.select(query_id, F.explode(F.array_distinct(analyze(F.col(query_col)))).alias("term"))
    q = F.broadcast(q) if q.count() <= QUERY_ROWS else q
    texts = docs.select(F.col(id_col), analyze(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    p, df, stats = counted_terms(texts, [id_col], q.select("term").distinct(), [])
    scored = p.join(df, "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = scored.select(id_col, "term", weight.alias("w")).join(q, "term").groupBy(query_id, id_col).agg(F.sum("w").alias("score"))
    return top_k(hits, query_id, [F.round("score", 9).desc(), F.col(id_col)], k)


def top_k(hits: DataFrame, query_id: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def optimized_query(docs: DataFrame, query: str, id_col: str, fields: dict[str, str], share: float = 0.75) -> DataFrame:
    """Best weighted field by term hits plus half a prefix phrase; at least ``share`` of the terms must occur."""
    terms = F.array_distinct(analyze(F.lit(query)))
    need = F.greatest(F.lit(1), F.floor(F.size(terms) * share))
    hits = {n: F.size(F.array_intersect(F.array_distinct(analyze(F.coalesce(F.col(c), F.lit("")))), terms)) for n, c in fields.items()}
    every = F.size(F.array_distinct(F.flatten(F.array(*[F.array_intersect(analyze(F.coalesce(F.col(c), F.lit(""))), terms) for c in fields.values()]))))
    scores = [hits[n] * BOOSTS.get(n, 1.0) for n in fields]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    phrase = F.greatest(*[F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower()).cast("double") for c in fields.values()], F.lit(0.0))
    return docs.where(every >= need).select(id_col, (best + 0.5 * phrase).alias("score"))


def deletions(word: Column, most: Column) -> Column:
    """The word, and what is left of it without one or two of its characters, as far as ``most`` allows."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.when((most >= 1) & (F.length(word) > 0), without(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(most >= 2, F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, without(w)).otherwise(F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def fuzzy_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Vocabulary words near each query term: no, one or two edits for up to 2, up to 5, and more letters.

    Two words within d edits leave a common rest when at most d characters are
    deleted from each, so the join is an equi-join on the rests, whose number grows
    with a word's length only; edits are then counted.
    """
    allowed = F.when(F.length("term") <= 2, 0).when(F.length("term") <= 5, 1).otherwise(2)
    t = terms.select("term", allowed.alias("allowed")).distinct()
    t = t.select("term", "allowed", F.explode(deletions(F.col("term"), F.col("allowed"))).alias("rest"))
    # one edit needs a term of three letters or more, two need one of six; a word may be that much shorter
    most = F.when(F.length("word") >= 4, 2).when(F.length("word") >= 2, 1).otherwise(0)
    v = vocabulary.select("word").distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("rest"))
    near = v.join(t, "rest").select("term", "word", "allowed").distinct()
    near = near.withColumn("edits", F.levenshtein("word", "term", 2))
    return near.where((F.col("edits") >= 0) & (F.col("edits") <= F.col("allowed"))).select("term", "word", "edits")


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = 0.7, after: bool = False) -> DataFrame:
    """Top k by cosine of every query vector: query_id, vec_id, score, rank.

    ``queries`` (query_id, q) go to all vectors in blocks of bounded bytes; tasks
    multiply blocks of both and keep each query's best, so that pairs are no rows.
    Vectors that are null, zero or hold nulls have no score and are in no result.  The
    threshold applies before the cut, or after it with ``after``.
    """
    parts = []
    for hits in nearest.candidates(vectors, queries, k, None if after else threshold):
        if threshold is not None and not after:
            hits = hits.where(F.col("score") >= threshold)
        hits = top_k(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k)
        parts.append(hits.where(F.col("score") >= threshold) if after and threshold is not None else hits)
    return reduce(DataFrame.unionByName, parts)


def search_filters(rows: DataFrame, tenant: str | int, filters: dict | None = None) -> DataFrame:
    """Rows of a tenant under the known filters: thread_id, has_attachments, sent_at {gte, lte}, attachment_types."""
    if tenant is None:
        raise ValueError("a tenant is required")
    rows = rows.where(F.col("tenant_id") == F.lit(tenant))
    for name, value in (filters or {}).items():
        if name in ("thread_id", "has_attachments"):
            rows = rows.where(F.col(name) == F.lit(value))
        elif name == "sent_at":
            if "gte" in value:
                rows = rows.where(F.col(name) >= F.lit(value["gte"]))
            if "lte" in value:
                rows = rows.where(F.col(name) <= F.lit(value["lte"]))
        elif name == "attachment_types":
            wanted = value if isinstance(value, list) else [value]
            rows = rows.where(F.arrays_overlap(name, F.array(*[F.lit(x) for x in wanted])))
    return rows


def terms_facet(rows: DataFrame, col: str, n: int = 10) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), col).limit(n)


def date_range_facet(rows: DataFrame, col: str, now: str) -> DataFrame:
    """Counts of the last day, the six before it and the 23 before those; from inclusive, to exclusive."""
    t = F.to_timestamp(F.lit(now))
    age = lambda lo, hi: F.count_if((F.col(col) >= t - F.expr(f"INTERVAL {lo} DAYS")) & (F.col(col) < t - F.expr(f"INTERVAL {hi} DAYS")))
    return rows.agg(age(1, 0).alias("last_day"), age(7, 1).alias("last_week"), age(30, 7).alias("last_month"))


def _substrings(sent):
    """(query_id, row, start) of every query that a text holds, by one automaton over all queries."""

    def run(batches: Iterable[pa.RecordBatch]):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for text, ids in sent.value:
            auto.add_word(text, (len(text), ids))
        auto.make_automaton()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                row, query, start = [], [], []
                for n, text in enumerate(part.column("_low").to_pylist()):
                    found: dict = {}
                    for end, (size, ids) in auto.iter(text or ""):
                        first = end == size - 1
                        for q in ids:
                            found[q] = first or found.get(q, False)
                    row += [n] * len(found)
                    query += found.keys()
                    start += found.values()
                kept = [part.column(c).take(pa.array(row, pa.int64())) for c in b.schema.names if c != "_low"]
                yield pa.record_batch([pa.array(query, pa.int64()), *kept, pa.array(start, pa.bool_())], names=["_q", *[c for c in b.schema.names if c != "_low"], "_first"])

    return run


def text_search(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, newest: str, k: int = 10, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """Case-insensitive substring search: the k newest matches of every query, .9 at the start of a text, else .7; by score.

    The queries are the stated query set: they are read in blocks of
    ``block_bytes``, each an automaton that passes over every text once, however many
    queries it holds.  An empty query is found in every text; a null one, and a null
    text, in none.
    """
    spark = chunks.sparkSession
    ship(spark)
    q = queries.select("query_id", F.lower("query").alias("ql")).where("ql is not null")
    texts = q.where("ql <> ''").groupBy("ql").agg(F.collect_set("query_id").alias("ids"))
    total = texts.agg(F.sum(F.octet_length("ql") + 8 * F.size("ids"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in dict.fromkeys([id_col, newest])}
    rows = chunks.where(F.col(text_col).isNotNull()).select(*kinds, F.lower(F.col(text_col)).alias("_low"))
    id_kind = queries.schema["query_id"].dataType
    parts = []
    for n in range(blocks):
        block = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("ql"), F.lit(blocks)) == n)
        got = [(r["ql"], r["ids"]) for r in block.collect()]
        if not got:
            continue
        names = sorted({x for _, ids in got for x in ids})
        number = {x: i for i, x in enumerate(names)}
        sent = spark.sparkContext.broadcast([(t, [number[x] for x in ids]) for t, ids in got])
        hits = rows.mapInArrow(_substrings(sent), ", ".join(["_q long", *[f"`{c}` {x}" for c, x in kinds.items()], "_first boolean"]))
        back = spark.createDataFrame(list(enumerate(names)), f"_q long, query_id {id_kind.simpleString()}")
        hits = hits.join(F.broadcast(back), "_q").select("query_id", *kinds, F.when(F.col("_first"), 0.9).otherwise(0.7).alias("score"))
        parts.append(top_k(hits, "query_id", [F.col(newest).desc(), F.col(id_col)], k).drop("rank"))
    # the newest texts of all are the hits of an empty query
    latest = rows.orderBy(F.col(newest).desc(), F.col(id_col)).limit(k).select(*kinds, F.lit(0.9).alias("score"))
    parts.append(q.where("ql = ''").select("query_id").join(F.broadcast(latest)))
    hits = reduce(DataFrame.unionByName, parts)
    return top_k(hits, "query_id", [F.col("score").desc(), F.col(newest).desc(), F.col(id_col)], k)


def highlight(c: Column, term: str, size: int = 150) -> Column:
    """A window of text around a term, the term in <em>."""
    at = F.locate(term.lower(), F.lower(c))
    piece = F.substring(c, F.greatest(F.lit(1), at - size // 2), F.lit(size))
    return F.when(at > 0, F.regexp_replace(piece, f"(?i)({term})", "<em>$1</em>"))


def fragments(c: Column, term: str, size: int = 150, n: int = 3) -> Column:
    """The first ``n`` pieces of a text, of ``size`` characters at most, around a term that is put in <em>; they do not overlap."""
    side, word = (size - len(term)) // 2, re.escape(term)
    around = F.regexp_extract_all(c, F.lit(f"(?is).{{0,{side}}}{word}.{{0,{side}}}"), F.lit(0))
    return F.transform(F.slice(around, 1, n), lambda x: F.regexp_replace(x, f"(?i)({word})", "<em>$1</em>"))


def highlights(hits: DataFrame, term: str, subject: str, content: str) -> DataFrame:
    """Adds ``highlight``: the whole subject, and three fragments of the content, where the term occurs in them."""
    word = re.escape(term)
    marked = F.when(F.col(subject).rlike(f"(?i){word}"), F.array(F.regexp_replace(F.col(subject), f"(?i)({word})", "<em>$1</em>"))).otherwise(F.array().cast("array<string>"))
    return hits.withColumn("highlight", F.struct(marked.alias("subject"), F.coalesce(fragments(F.col(content), term), F.array().cast("array<string>")).alias("content")))


def citations(hits: DataFrame, source: str) -> DataFrame:
    """Result rows as citations: preview of 200, snippet of 150 characters, uid with the source."""
    return hits.select(
        "email_id",
        F.concat_ws("_", F.lit(source), F.col("chunk_id").cast("string")).alias("chunk_uid"),
        "score",
        snippet(F.col("content"), 200).alias("content_preview"),
        snippet(F.col("content"), 150).alias("snippet"),
    )


def validate_query(c: Column) -> tuple[Column, Column]:
    """(is_valid, warnings) of a search query."""
    q = strip(F.coalesce(c, F.lit("")))
    low = F.lower(q)
    bad = None
    for p in reversed(DANGEROUS):
        found = F.array(F.lit(f"Query contains potentially dangerous pattern: {p}"))
        bad = F.when(low.contains(p), found) if bad is None else F.when(low.contains(p), found).otherwise(bad)
    parts = F.split(F.regexp_replace(q, "[ \t\n\r\f\x0b]+", " "), " ")
    soft = F.array_compact(
        F.array(
            F.when(F.length(q) > 500, F.concat(F.lit("Query length "), F.length(q).cast("string"), F.lit(" exceeds recommended limit of 500 characters"))),
            F.when(F.size(parts) < 2, "Very short queries may return low-quality results"),
            F.when(F.forall(parts, lambda w: F.lower(w).isin(GENERIC)), "Query contains only generic terms - consider more specific language"),
        )
    )
    hard = F.when(F.length(q) == 0, F.array(F.lit("Query cannot be empty"))).when(q.isin(WILDCARDS), F.array(F.lit("Wildcard-only queries are not allowed"))).otherwise(bad)
    return hard.isNull(), F.coalesce(hard, soft)


def index_health(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.groupBy("tenant_id").agg(F.count("*").alias("doc_count"), F.sum(F.octet_length(text_col)).alias("size_bytes"))


def upsert(index: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of both tables."""
    both = index.unionByName(changes)
    newest = both.groupBy(key).agg(F.max(version).alias(version))
    return both.join(newest, [key, version]).dropDuplicates([key])


def delete(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def denormalize(chunks: DataFrame, emails: DataFrame) -> DataFrame:
    """Index rows: each chunk with its e-mail's headers."""
    return chunks.join(emails, "email_id")


def main_types(types: Column) -> Column:
    """Different main parts of mime types, in order of first appearance."""
    return F.array_distinct(F.transform(types, lambda x: F.substring_index(x, "/", 1)))


def pending_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs with retries left are pending again."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries"))
    return jobs.withColumns(
        {"retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "status": F.when(again, "pending").otherwise(F.col("status"))}
    )
