"""Hybrid retrieval: BM25 over weighted fields, fused with vectors, reranked, paged; guards around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import fusion
from .search import BOOSTS, QUERY_ROWS, analyze, counted_terms, fuzzy_terms, snippet, top_k

#: Characters of a request that are kept, results at most, and the fewest without a say.
REQUEST_CHARS, REQUEST_LIMIT = 500, 20


def bm25_fields(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str,
    fields: dict[str, str],
    query_id: str,
    query_col: str,
    k: int = 10,
    newest: str | None = None,
    fuzzy: bool = False,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Top k documents of every query by their best field: query_id, id, field, score, rank.

    ``fields`` maps a field's name (weighted by ``BOOSTS``) to its column.  Every
    field has its own statistics; a document scores as its best weighted field does.
    Ties go by ``newest``, the latest first, then by id.  With ``fuzzy`` a query term
    also stands for the words near it, each weighted by 1 - edits / letters.  Query
    terms are the stated query set: postings of other terms go before any shuffle.
    """
    each = [F.struct(F.lit(n).alias("field"), F.lit(float(BOOSTS.get(n, 1.0))).alias("boost"), analyze(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("terms")) for n, c in fields.items()]
    t = docs.select(id_col, F.explode(F.array(*each)).alias("f")).select(id_col, "f.*")
    q = queries.select(query_id, F.explode(F.array_distinct(analyze(F.col(query_col)))).alias("term")).withColumn("share", F.lit(1.0))
    if fuzzy:
        near = fuzzy_terms(t.select(F.explode("terms").alias("word")).distinct(), q.select("term").distinct())
        near = near.withColumn("share", 1 - F.col("edits") / F.least(F.length("term"), F.length("word")))
        q = q.drop("share").join(near, "term").groupBy(query_id, F.col("word").alias("term")).agg(F.max("share").alias("share"))
    q = F.broadcast(q) if q.count() <= QUERY_ROWS else q
    tf, df, stats = counted_terms(t, [id_col, "field", "boost"], q.select("term").distinct(), ["field"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, ["field", "term"]).join(F.broadcast(stats), "field").join(q, "term")
    by_field = scored.groupBy(query_id, id_col, "field").agg((F.sum(weight * F.col("share")) * F.max("boost")).alias("s"))
    best = by_field.groupBy(query_id, id_col).agg(F.max(F.struct(F.round("s", 9).alias("score"), "field")).alias("b"))
    hits = best.select(query_id, id_col, F.col("b.field").alias("field"), F.col("b.score").alias("score"))
    order = [F.col("score").desc()]
    if newest:
        hits = hits.join(docs.select(id_col, newest), id_col)
        order.append(F.col(newest).desc())
    return top_k(hits, query_id, [*order, F.col(id_col)], k)


def page(hits: DataFrame, size: int, start: int = 0) -> DataFrame:
    """``size`` results of every query after the first ``start``."""
    return hits.where((F.col("rank") > start) & (F.col("rank") <= start + size))


def hybrid_search(words: DataFrame, vectors: DataFrame, size: int, scorer: Column | None = None) -> DataFrame:
    """Fuses two ranked lists (query_id, chunk_id, rank, score), each of twice ``size``, and cuts to ``size``.

    A query that only one side answers keeps that side's scores.  With ``scorer`` the
    fused list is reranked before the cut.  query_id, chunk_id, score, sources, rank.
    """
    both = fusion.fuse(words.where(F.col("rank") <= 2 * size), vectors.where(F.col("rank") <= 2 * size))
    has = lambda name: F.bool_or(F.array_contains("sources", name))
    sides = both.groupBy("query_id").agg((has("bm25") & has("vector")).alias("fused"))
    alone = F.greatest("bm25_score", "vector_score")
    scored = both.join(sides, "query_id").withColumn("fused_score", F.when(F.col("fused"), F.col("fused_score")).otherwise(alone))
    if scorer is None:
        out = top_k(scored, "query_id", [F.round("fused_score", 12).desc(), F.col("chunk_id")], size).withColumn("score", F.col("fused_score"))
    else:
        out = fusion.rerank(scored, scorer).where(F.col("rank") <= size).withColumn("score", F.col("final_score"))
    return out.select("query_id", "chunk_id", "score", "sources", "rank")


def pass_through_rerank(fused: DataFrame, limit: int = 100) -> DataFrame:
    """The reranker that changes nothing: the first ``limit`` in their order."""
    return top_k(fused, "query_id", [F.round("fused_score", 12).desc(), F.col("chunk_id")], limit)


def stub_search(queries: DataFrame, n: int = 5) -> DataFrame:
    """At most five made-up results of every query: score 1 - 0.1 i."""
    i = F.explode(F.sequence(F.lit(0), F.lit(min(n, 5) - 1)))
    return queries.select("query_id", i.alias("i")).select("query_id", F.concat_ws("-", F.lit("stub"), F.col("i").cast("string")).alias("chunk_id"), F.round(1 - F.col("i") * 0.1, 1).alias("score"))


def retrieve(hybrid: DataFrame | None, text: DataFrame | None) -> DataFrame:
    """Hybrid results of every query that has some, else those of the text search; at least one side must be there.

    Both have query_id, chunk_id, score, rank; adds the path taken.
    """
    if hybrid is None and text is None:
        raise ValueError("no search is available")
    sides = []
    if hybrid is not None:
        sides.append(hybrid.select("query_id", "chunk_id", "score", "rank", F.lit("hybrid").alias("path")))
    if text is not None:
        rest = text if hybrid is None else text.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
        sides.append(rest.select("query_id", "chunk_id", "score", "rank", F.lit("sql").alias("path")))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def guard_requests(requests: DataFrame, query_col: str = "query", limit_col: str = "k") -> DataFrame:
    """Requests as they are run: the query stripped and cut to 500 characters, at most 20 results; without tenant or query they go."""
    q = F.substring(strip(F.coalesce(F.col(query_col), F.lit(""))), 1, REQUEST_CHARS)
    k = F.least(F.coalesce(F.col(limit_col), F.lit(REQUEST_LIMIT)), F.lit(REQUEST_LIMIT))
    return requests.withColumns({query_col: q, limit_col: k}).where(F.col("tenant_id").isNotNull() & (F.length(query_col) > 0))


def own_citations(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits whose tenant is that of their request; others are dropped."""
    mine = requests.select("query_id", F.col("tenant_id").alias("_tenant"))
    return hits.join(mine, "query_id").where(F.col("tenant_id") == F.col("_tenant")).drop("_tenant")


def citation_by_uid(chunks: DataFrame, wanted: DataFrame, uid: str, text: str) -> DataFrame:
    """Chunks looked up by their id: score 1.0, preview and snippet."""
    found = chunks.join(wanted.select(uid).distinct(), uid, "left_semi")
    return found.select(uid, F.lit(1.0).alias("score"), snippet(F.col(text), 200).alias("content_preview"), snippet(F.col(text), 150).alias("snippet"))


def highlight_fields(a: Column, b: Column) -> Column:
    """Names of the fields that either highlight map has, sorted."""
    none = F.create_map().cast("map<string,array<string>>")
    return F.array_sort(F.array_union(F.map_keys(F.coalesce(a, none)), F.map_keys(F.coalesce(b, none))))


def analytics(performance: DataFrame, healthy: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = 60) -> DataFrame:
    """One row: the fusion's settings, its performance rows and the health of the indexes."""
    pack = lambda d, n: d.agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(n))  # noqa: E731  # a row for each tenant
    return pack(performance, "performance").join(pack(healthy, "health")).withColumn("config", F.struct(F.lit(k).alias("k"), F.lit(weights[0]).alias("bm25_weight"), F.lit(weights[1]).alias("vector_weight")))
