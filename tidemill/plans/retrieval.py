"""Registered queries of hybrid retrieval, its guards and its quality; normalization as one operator; duplicate decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, hybrid, metrics, normalize, search
from ..sources.work import cut
from .catalog import _ANALYZE, _BM25_SQL, _LINE, _MRR, _NDCG, _SIMHASH_SQL, NORM_SQL, _bm25, _hit, _strip, query, t

_FIELDS_SQL = f"""
f AS (SELECT doc_id, 'subject' AS field, 2.0::DOUBLE AS boost, {_ANALYZE.format(c="coalesce(text[1:60], '')")} AS w FROM documents
      UNION ALL SELECT doc_id, 'content', 1.0, {_ANALYZE.format(c="coalesce(text, '')")} FROM documents
      UNION ALL SELECT doc_id, 'from_addr', 1.5, {_ANALYZE.format(c="coalesce(source, '')")} FROM documents),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM f GROUP BY field),
tf AS (SELECT doc_id, field, boost, dl, term, count(*) AS tf FROM (SELECT doc_id, field, boost, len(w) AS dl, unnest(w) AS term FROM f) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_ANALYZE.format(c="text")}) AS term FROM benchmark),
by_field AS (SELECT query_id, doc_id, field, round(max(boost) * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
             FROM tf JOIN df USING (field, term) JOIN st USING (field) JOIN q USING (term) GROUP BY ALL),
best AS (SELECT query_id, doc_id, max(score) AS score FROM by_field GROUP BY ALL),
mf AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM best)
"""


def _multi(spark, sf, k):
    d = t(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("head"), "text", "source", F.col("doc_id").alias("sent_at"))
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return hybrid.bm25_fields(d, q, "doc_id", {"subject": "head", "content": "text", "from_addr": "source"}, "query_id", "query", k, newest="sent_at")


@query(f"WITH {_FIELDS_SQL} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM mf WHERE rank <= 10")
def bm25_multi_field(spark, sf):
    return _multi(spark, sf, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_FIELDS_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM mf WHERE rank > 20 AND rank <= 35")
def search_page(spark, sf):
    return hybrid.page(_multi(spark, sf, 35), 15, 20).select("query_id", "doc_id", "rank")


_HYBRID_SQL = f"""
{_BM25_SQL},
qv AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
vh AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, qv WHERE vec_id <> query_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vh WHERE score >= 0.25),
a AS (SELECT query_id, doc_id AS chunk_id, rank - 1 AS r1, score AS s1 FROM bm WHERE rank <= 20),
b AS (SELECT query_id, vec_id AS chunk_id, rank - 1 AS r2, score AS s2 FROM vr WHERE rank <= 20),
u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, r1, r2, s1, s2 FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
sides AS (SELECT query_id, count(r1) > 0 AND count(r2) > 0 AS fused FROM u GROUP BY query_id),
h AS (SELECT query_id, chunk_id, r1, r2, CASE WHEN fused THEN 1.0::DOUBLE / (60 + coalesce(r1, 60)) + 1.0::DOUBLE / (60 + coalesce(r2, 60)) ELSE greatest(coalesce(s1, 0), coalesce(s2, 0)) END AS score FROM u JOIN sides USING (query_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM h)
"""


def _lists(spark, sf, size):
    e = t(spark, sf, "embeddings")
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    v = search.vector_top_k(e.select("vec_id", "embedding"), q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id"), 2 * size, threshold=0.25)
    return _bm25(spark, sf, 2 * size).withColumnRenamed("doc_id", "chunk_id"), v.withColumnRenamed("vec_id", "chunk_id")


@query(
    f"""WITH {_HYBRID_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, concat_ws(',', CASE WHEN r1 IS NOT NULL THEN 'bm25' END, CASE WHEN r2 IS NOT NULL THEN 'vector' END) AS sources,
CAST(rank AS INTEGER) AS rank FROM hy WHERE rank <= 10"""
)
def hybrid_search(spark, sf):
    h = hybrid.hybrid_search(*_lists(spark, sf, 10), 10)
    return h.withColumn("score", F.round("score", 6)).withColumn("sources", F.array_join("sources", ","))


@query(
    f"""WITH {_HYBRID_SQL}, top AS (SELECT *, abs(sin(chunk_id)) AS rr FROM hy WHERE rank <= 100),
z AS (SELECT query_id, chunk_id, round(0.7 * score + 0.3 * rr, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, chunk_id) AS rank FROM top)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 10"""
)
def hybrid_reranked(spark, sf):
    h = hybrid.hybrid_search(*_lists(spark, sf, 10), 10, F.abs(F.sin(F.col("chunk_id").cast("double"))))
    return h.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_KS = (1, 3, 5, 10)


def _prf_sql(k: int) -> str:
    f, a = f"len(list_filter(v[1:{k}], lambda x: x > 0.5))", "len(list_filter(v, lambda x: x > 0.5))"
    p, r = f"({f} / {k}.0::DOUBLE)", f"(CASE WHEN {a} > 0 THEN {f} / {a}::DOUBLE ELSE 0.0 END)"
    f1 = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return ", ".join(f"CASE WHEN len(v) >= {k} THEN round({x}, 6) END AS {n}_at_{k}" for n, x in (("precision", p), ("recall", r), ("f1", f1)))


@query(
    f"""WITH {_HYBRID_SQL}, top AS (SELECT * FROM hy WHERE rank <= 10),
rel AS (SELECT query_id, rank, CAST(CASE WHEN contains(lower(d.text), lower(b.text)) THEN 1.0 WHEN l.quality = 1 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS s
        FROM top JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id LEFT JOIN labels l USING (doc_id)),
s AS (SELECT query_id, list(s ORDER BY rank) AS v FROM rel GROUP BY query_id)
SELECT query_id, {", ".join(f"round({_hit(k)}, 6) AS hit_at_{k}" for k in _KS)}, round({_MRR}, 6) AS mrr, round({_NDCG}, 6) AS ndcg, {", ".join(map(_prf_sql, _KS))} FROM s"""
)
def hybrid_search_benchmark(spark, sf):
    from ..sources.work import cut

    d, b, lab = (t(spark, sf, n) for n in ("documents", "benchmark", "labels"))
    # the ranked lists are written once: they are joined to the texts, and choose them
    top = cut(hybrid.hybrid_search(*_lists(spark, sf, 10), 10).select("query_id", F.col("chunk_id").alias("doc_id"), "rank"), spark)
    low = d.select("doc_id", F.lower("text").alias("low")).join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    rel = top.join(low, "doc_id").join(b.select(F.col("item_id").alias("query_id"), F.lower("text").alias("asked")), "query_id").join(lab.select("doc_id", "quality"), "doc_id", "left")
    rel = rel.withColumn("s", F.when(F.col("low").contains(F.col("asked")), 1.0).when(F.col("quality") == 1, 0.6).otherwise(0.2))
    q = metrics.quality(metrics.score_lists(rel, ["query_id"], "rank", "s"), ["query_id"])
    return q.select("query_id", *[F.round(c, 6).alias(c) for c in q.columns if c != "query_id"])


@query("SELECT b.item_id AS query_id, 'stub-' || i AS chunk_id, round(1 - i * 0.1::DOUBLE, 1) AS score FROM benchmark b, range(5) r(i)")
def stub_search(spark, sf):
    return hybrid.stub_search(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


_REQUESTS_SQL = f"""
r AS (SELECT conv_id * 1000 + turn AS query_id, conv_id % 3 AS tenant_id, regexp_replace(text, '^{X.WS}+|{X.WS}+$', '', 'g')[1:500] AS query, least(turn * 9 + 5, 20) AS k FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT * FROM r WHERE length(query) > 0)
"""


def _requests(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 3).alias("tenant_id"), F.col("text").alias("query"), (F.col("turn") * 9 + 5).alias("k"))


@query(f"WITH {_REQUESTS_SQL} SELECT query_id, tenant_id, query, k FROM g")
def request_guard(spark, sf):
    return hybrid.guard_requests(_requests(spark, sf))


@query(f"WITH {_REQUESTS_SQL}, hits AS (SELECT event_id, user_id * 1000 + event_id % 4 AS query_id, event_id % 3 AS tenant_id FROM events) SELECT event_id, query_id, h.tenant_id FROM hits h JOIN g USING (query_id) WHERE h.tenant_id = g.tenant_id")
def own_citations(spark, sf):
    e = t(spark, sf, "events").select("event_id", (F.col("user_id") * 1000 + F.col("event_id") % 4).alias("query_id"), (F.col("event_id") % 3).alias("tenant_id"))
    return hybrid.own_citations(e, hybrid.guard_requests(_requests(spark, sf))).select("event_id", "query_id", "tenant_id")


@query("SELECT doc_id, 1.0::DOUBLE AS score, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS content_preview, CASE WHEN length(text) > 150 THEN text[1:150] || '...' ELSE text END AS snippet FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def citation_lookup(spark, sf):
    return hybrid.citation_by_uid(t(spark, sf, "documents"), t(spark, sf, "labels").where("toxic = 1"), "doc_id", "text")


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS fields FROM conversations GROUP BY conv_id")
def highlight_fields(spark, sf):
    c = t(spark, sf, "conversations")
    half = lambda where: F.map_from_entries(F.array_distinct(F.collect_list(F.when(where, F.struct("role", F.array(F.lit("x")))))))
    m = c.groupBy("conv_id").agg(half(F.col("turn") % 2 == 0).alias("a"), half(F.col("turn") % 2 == 1).alias("b"))
    return m.select("conv_id", F.array_join(hybrid.highlight_fields(F.col("a"), F.col("b")), ",").alias("fields"))


@query(
    f"""WITH {_HYBRID_SQL}, ql AS (SELECT query_id, chunk_id, rank FROM hy WHERE rank <= 10 AND query_id IN (SELECT query_id FROM hy WHERE rank = 10)),
tx AS (SELECT item_id AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text)))
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, 'hybrid' AS path FROM ql
UNION ALL SELECT query_id, chunk_id, CAST(rank AS INTEGER), 'sql' FROM tx WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM ql)"""
)
def retrieve_with_fallback(spark, sf):
    """A query with ten hybrid hits is answered by them; one with fewer falls back to the text search."""
    h = cut(hybrid.hybrid_search(*_lists(spark, sf, 10), 10), spark)
    h = h.join(h.where("rank = 10").select("query_id"), "query_id", "left_semi")
    d = t(spark, sf, "documents").select("doc_id", "text", (-F.col("doc_id")).alias("newest"))
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    s = search.text_search(d, q, "doc_id", "text", "newest").withColumnRenamed("doc_id", "chunk_id")
    s = search.top_k(s.drop("rank"), "query_id", [F.col("chunk_id")], 10)
    return hybrid.retrieve(h, s).select("query_id", "chunk_id", "rank", "path")


# ---------------------------------------------------------------- duplicate decision
@query(
    f"""WITH {_SIMHASH_SQL},
first AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text),
e AS (SELECT doc_id, CASE WHEN doc_id <> first_id THEN first_id END AS exact_id FROM documents JOIN first ON documents.text IS NOT DISTINCT FROM first.text),
reps AS (SELECT simhash, min(doc_id) AS rep FROM hashes GROUP BY simhash),
near AS (SELECT a.simhash, min(b.rep) AS near_id FROM reps a JOIN reps b ON bit_count(xor(a.simhash, b.simhash)) <= 9 GROUP BY a.simhash)
SELECT doc_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN near_id < doc_id THEN 'near' ELSE 'none' END AS duplicate_type,
  CASE WHEN exact_id IS NOT NULL THEN exact_id WHEN near_id < doc_id THEN near_id ELSE -1 END AS original_id
FROM e JOIN hashes USING (doc_id) JOIN near USING (simhash)"""
)
def duplicate_decision(spark, sf):
    from ..sources.work import cut

    d = t(spark, sf, "documents").select("doc_id", "text", dedup.content_hash(F.col("text")).alias("content_hash"))
    exact = dedup.exact_duplicates(d.select("doc_id", F.coalesce("content_hash", F.lit("")).alias("content_hash")), "doc_id")
    hashes = cut(dedup.simhash(d, "doc_id", "text"), spark)
    d = dedup.decide(exact, hashes, "doc_id")
    return d.withColumn("original_id", F.coalesce("original_id", F.lit(-1)))


# ---------------------------------------------------------------- normalization as one operator
@query(
    f"""WITH l AS (SELECT doc_id, text, string_split({NORM_SQL}, chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, text, lines, list_position(list_transform(lines, lambda x: regexp_matches({_strip('x')}, '{_LINE}')), true) AS cut FROM l),
n AS (SELECT doc_id, text, {_strip("array_to_string(CASE WHEN coalesce(cut, 0) > 0 THEN lines[1:cut - 1] ELSE lines END, chr(10))")} AS norm FROM f)
SELECT doc_id, CAST(length(norm) AS BIGINT) AS length_chars, CAST(greatest(1, length(norm) // 4) AS BIGINT) AS token_estimate, sha256(norm) AS normalized_text_hash,
  sha256(text) AS raw_content_hash, CAST(0 AS BIGINT) AS stripped_blocks, 'plain_text_cleanup,signature_stripping,quote_stripping,whitespace_normalization' AS steps FROM n"""
)
def normalize_content(spark, sf):
    n = normalize.normalize_content(t(spark, sf, "documents").select("doc_id", "text"), "text", F.lit("text/plain"))
    m = n.select("doc_id", "normalized_text_hash", "raw_content_hash", "manifest.*")
    return m.select("doc_id", "length_chars", "token_estimate", "normalized_text_hash", "raw_content_hash", "stripped_blocks", F.array_join("normalization_steps", ",").alias("steps"))
