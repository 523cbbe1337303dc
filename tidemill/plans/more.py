"""Further registered queries: citations, jobs, patches, indexes, dates, assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import attachments, audit, chunking, dedup, drafts, jobs, metrics, search, threading
from ..sources import checkpoints, messages
from ..streaming import guards
from .catalog import _ANALYZE, _CHUNK_SQL, _JOBS, _VISIBLE, _PERF_SQL, _SCORES_SQL, _jobs, _list, _performance, _scores, _thread_messages, query, t


@query(f"SELECT priority, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ({_JOBS}) GROUP BY priority")
def task_counts(spark, sf):
    return attachments.task_counts(_jobs(spark, sf).select("priority", "status"), ["priority"])


@query("SELECT CAST(doc_id AS VARCHAR) AS email_id, 'sql_' || doc_id AS chunk_uid, 1.0::DOUBLE AS score, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS content_preview, CASE WHEN length(text) > 150 THEN text[1:150] || '...' ELSE text END AS snippet FROM documents")
def citations(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("email_id"), F.col("doc_id").alias("chunk_id"), F.lit(1.0).alias("score"), F.col("text").alias("content"))
    return search.citations(d, "sql")


@query(
    """
WITH d AS (SELECT conv_id AS draft_id, string_agg(text, ' ' ORDER BY turn) AS draft_text FROM conversations GROUP BY 1),
c AS (SELECT conv_id AS draft_id, conv_id || '-' || turn AS chunk_uid, 'mail' || turn AS email_id, turn / 10 AS score, text[1:200] AS content_preview FROM conversations WHERE role <> 'system'),
u AS (SELECT draft_id, chunk_uid, score FROM d JOIN c USING (draft_id) WHERE (length(content_preview) > 10 AND contains(lower(draft_text), lower(content_preview[1:50]))) OR contains(lower(draft_text), lower(email_id))),
r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, chunk_uid) AS rank FROM u)
SELECT draft_id, chunk_uid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""
)
def used_citations(spark, sf):
    c = t(spark, sf, "conversations")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    d = c.groupBy(F.col("conv_id").alias("draft_id")).agg(joined.alias("draft_text"))
    uid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    cites = c.where("role <> 'system'").select(F.col("conv_id").alias("draft_id"), uid.alias("chunk_uid"), F.concat(F.lit("mail"), F.col("turn").cast("string")).alias("email_id"), (F.col("turn") / 10).alias("score"), F.substring("text", 1, 200).alias("content_preview"))
    return drafts.used_citations(d, cites).select("draft_id", "chunk_uid", "rank")


@query("WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT conv_id, array_to_string([i || '. ' || x FOR x, i IN l[1:3]], chr(10)) AS prompt FROM l")
def prompt_citations(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("p")))).alias("l"))
    return c.select("conv_id", drafts.prompt_citations(F.transform("l", lambda x: x["p"])).alias("prompt"))


@query("SELECT doc_id, regexp_replace(substring(text, greatest(1, position('the' IN lower(text)) - 75), 150), '(?i)(the)', '<em>\\1</em>', 'g') AS fragment FROM documents WHERE contains(lower(text), 'the')")
def highlight(spark, sf):
    return t(spark, sf, "documents").select("doc_id", search.highlight(F.col("text"), "the").alias("fragment")).where("fragment is not null")


_TERMS = ["est", "thand", "from"]


@query(
    f"""
WITH w AS (SELECT doc_id, lower(text) AS low, list_distinct({_ANALYZE.format(c='text')}) AS w FROM documents),
h AS (SELECT doc_id, low, len(list_intersect(w, {_list(_TERMS)})) AS n FROM w)
SELECT doc_id, CAST(n + 0.5 * contains(low, 'est thand from')::INT AS DOUBLE) AS score FROM h WHERE n >= 2
"""
)
def optimized_query(spark, sf):
    return search.optimized_query(t(spark, sf, "documents"), "est thand from", "doc_id", {"content": "text"})


@query("WITH l AS (SELECT user_id % 7 AS k, list(CASE WHEN event_type = 'click' THEN 'image/png' WHEN event_type = 'view' THEN 'image/gif' ELSE 'text/plain' END ORDER BY event_id) AS l FROM events GROUP BY 1), m AS (SELECT k, list_transform(l, lambda x: string_split(x, '/')[1]) AS m FROM l) SELECT k, array_to_string([x FOR x, i IN m IF list_position(m, x) = i], ',') AS kinds FROM m")
def attachment_main_types(spark, sf):
    kind = F.when(F.col("event_type") == "click", "image/png").when(F.col("event_type") == "view", "image/gif").otherwise("text/plain")
    e = t(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("k")).agg(F.sort_array(F.collect_list(F.struct("event_id", kind.alias("t")))).alias("l"))
    return e.select("k", F.array_join(search.main_types(F.transform("l", lambda x: x["t"])), ",").alias("kinds"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def index_delete(spark, sf):
    e = t(spark, sf, "events")
    return search.delete(e.select("event_id", "user_id"), e.where("event_type = 'error'"), "user_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def thread_cleanup(spark, sf):
    m = _thread_messages(spark, sf)
    return threading.drop_threads(m, m.where("role = 'system'")).select(F.col("thread_id").alias("conv_id"), "turn")


@query("SELECT event_id, date_trunc('second', ts) AS sent_at FROM events")
def parse_dates(spark, sf):
    text = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss")
    return t(spark, sf, "events").select("event_id", messages.parse_date(F.concat(text, F.lit(" +0000"))).alias("sent_at"))


@query("WITH p AS (SELECT user_id, event_type, min(ts) FILTER (event_id % 2 = 0) AS a, max(ts) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL) SELECT user_id AS workflow_id, event_type AS step, (epoch_us(b) - epoch_us(a)) / 1000 AS duration_ms, CASE WHEN b IS NULL THEN 'running' ELSE 'completed' END AS status FROM p")
def step_timing(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("workflow_id"), F.col("event_type").alias("step"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("mark"), "ts")
    return metrics.pair_steps(e)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def patch_running(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("state"))
    return attachments.fold_running(e, "user_id", "event_id", ["state"])


@query("SELECT user_id, coalesce(nullif(trim(string_split(CASE WHEN user_id % 2 = 0 THEN ' 10.0.0.' || user_id || ' , 10.1.1.1' ELSE '' END, ',')[1]), ''), CASE WHEN user_id % 3 = 0 THEN '10.2.2.2' END, 'peer') AS ip FROM (SELECT DISTINCT user_id FROM events)")
def client_ip(spark, sf):
    u = t(spark, sf, "events").select("user_id").distinct()
    forwarded = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 10.1.1.1"))).otherwise("")
    return u.select("user_id", guards.client_ip(forwarded, F.when(F.col("user_id") % 3 == 0, "10.2.2.2"), F.lit("peer")).alias("ip"))


@query(f"WITH {_SCORES_SQL} SELECT user_id, round(list_sum([x / log2(i + 1) FOR x, i IN v[1:10]]) / list_sum([x / log2(i + 1) FOR x, i IN list_reverse_sort(v[1:10])]), 9) AS ndcg FROM s")
def ndcg_log2(spark, sf):
    return _scores(spark, sf).select("user_id", F.round(N.ndcg_linear(F.col("scores"), 10, log2=True), 9).alias("ndcg"))


@query("SELECT conv_id, turn, contains(lower(text), 'the') AS has_the, NOT contains(lower(text), 'que') AS no_que FROM conversations")
def answer_assertions(spark, sf):
    c = t(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("case_id"), F.col("text").alias("answer"))
    checks = c.select("case_id", F.explode(F.array(F.struct(F.lit("contains").alias("kind"), F.lit("the").alias("value")), F.struct(F.lit("not-contains").alias("kind"), F.lit("que").alias("value")))).alias("x")).select("case_id", "x.*")
    got = drafts.assertions(c, checks).groupBy("case_id").agg(F.bool_or(F.when(F.col("kind") == "contains", F.col("passed"))).alias("has_the"), F.bool_or(F.when(F.col("kind") != "contains", F.col("passed"))).alias("no_que"))
    return got.select("case_id.*", "has_the", "no_que")


@query(f"WITH {_PERF_SQL} SELECT user_id, round(100.0 * successful_searches / total_searches, 6) AS percent, round(successful_searches / 60.0, 6) AS rate FROM perf")
def batch_progress(spark, sf):
    p = _performance(spark, sf).select("user_id", F.col("total_searches").alias("total"), F.col("successful_searches").alias("done"), F.lit(60.0).alias("elapsed"))
    return metrics.progress(p).select("user_id", F.round("percent", 6).alias("percent"), F.round("rate", 6).alias("rate"))


@query("SELECT user_id, map_entries(map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type)))::VARCHAR <> '' AS has_types, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def distribution_maps(spark, sf):
    d = metrics.distribution_map(t(spark, sf, "events"), ["user_id"], "event_type")
    return d.select("user_id", (F.size("counts") > 0).alias("has_types"), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, event_id, ts, rn, true AS admitted, NULL::TIMESTAMP AS a1, CAST(ts AS TIMESTAMP) AS a2 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.ts, e.rn, r.a1 IS NULL OR r.a1 <= CAST(e.ts AS TIMESTAMP) - INTERVAL 1 HOUR,
    CASE WHEN r.a1 IS NULL OR r.a1 <= CAST(e.ts AS TIMESTAMP) - INTERVAL 1 HOUR THEN r.a2 ELSE r.a1 END,
    CASE WHEN r.a1 IS NULL OR r.a1 <= CAST(e.ts AS TIMESTAMP) - INTERVAL 1 HOUR THEN CAST(e.ts AS TIMESTAMP) ELSE r.a2 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, ts, admitted FROM r
"""
)
def admitted_requests(spark, sf):
    return guards.admitted(t(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", 2, 3600)


_BOTH = _CHUNK_SQL.replace("FROM documents)", "FROM bodies)").replace("SELECT doc_id, ", "SELECT doc_id, kind, ").replace("PARTITION BY doc_id", "PARTITION BY doc_id, kind")


@query(
    f"""WITH RECURSIVE bodies AS (SELECT doc_id, 'text' AS kind, text FROM documents UNION ALL SELECT page_id, 'attachment', {_VISIBLE} FROM pages WHERE length({_VISIBLE}) > 0),
{_BOTH.replace('RECURSIVE ', '')}
SELECT doc_id AS email_id, kind AS chunk_type, CAST(chunk_index AS INTEGER) AS chunk_index, doc_id || '_' || chunk_index || '_' || sha256(content)[1:8] AS chunk_uid FROM chunks"""
)
def body_and_attachment_chunks(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("email_id"), "text")
    p = t(spark, sf, "pages").select(F.col("page_id").alias("email_id"), X.visible_text(F.col("html")).alias("text"))
    return chunking.body_and_attachment_chunks(d, p).select("email_id", "chunk_type", "chunk_index", "chunk_uid")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, event_id FROM events WHERE event_type <> 'error' OR event_type IS NULL) GROUP BY user_id")
def union_all(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type")
    failed, others = e.where("event_type = 'error'"), e.where("event_type <> 'error' or event_type is null")
    return failed.unionByName(others).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lineage_semijoin(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')) >= 100")
def near_dup_candidates(spark, sf):
    return dedup.near_candidates(t(spark, sf, "documents"), "text").select("doc_id")


@query("SELECT sha256('t:' || doc_id) AS id, doc_id AS chunk_id, 'pending' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def enqueue_jobs(spark, sf):
    d = t(spark, sf, "documents").select(F.lit("t").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("email_id"), F.col("text").alias("content"))
    new = jobs.enqueue(d, t(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), F.lit("2024-01-01").cast("timestamp"))
    return new.select("id", "chunk_id", "status")


@query("SELECT event_type, round(avg((event_id % 20 <> 0)::INT), 6) AS success_rate, round(quantile_cont(value, 0.95), 6) AS p95_ms, CASE WHEN avg((event_id % 20 <> 0)::INT) >= 0.95 THEN 'healthy' WHEN avg((event_id % 20 <> 0)::INT) >= 0.8 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events GROUP BY 1")
def embedding_health(spark, sf):
    e = t(spark, sf, "events").select("event_type", (F.col("event_id") % 20 != 0).alias("ok"), F.col("value").alias("ms"))
    return jobs.health(e, ["event_type"]).select("event_type", F.round("success_rate", 6).alias("success_rate"), F.round("p95_ms", 6).alias("p95_ms"), "status")


@query(
    """
WITH s AS (SELECT user_id, count(*) AS steps, round(sum(value), 6) AS total_ms, list_sort(list(value) FILTER (value > 0)) AS v, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS u FROM events GROUP BY 1)
SELECT user_id AS workflow_id, steps, total_ms, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95_ms, failures, round(u / n, 6) AS retrieval_hit_k FROM s JOIN c USING (user_id)
"""
)
def audit_trace(spark, sf):
    e = t(spark, sf, "events")
    steps = e.select(F.col("user_id").alias("workflow_id"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    cites = e.select(F.col("user_id").alias("workflow_id"), F.col("event_id").alias("chunk_uid"))
    out = audit.export_trace(steps, audit.mark_used(cites, cites.where("chunk_uid % 5 = 0")))
    return out.withColumn("total_ms", F.round("total_ms", 6)).withColumn("retrieval_hit_k", F.round("retrieval_hit_k", 6))


@query("SELECT user_id % 5 AS batch_id, count(*) FILTER (event_id % 4 = 0) AS processed_emails, count(*) FILTER (event_id % 4 = 1) AS failed_emails, max(CAST(event_id AS VARCHAR)) AS last_processed_email, true AS is_complete FROM events GROUP BY 1")
def checkpoint_progress(spark, sf):
    k = F.col("event_id") % 4
    e = t(spark, sf, "events").select((F.col("user_id") % 5).alias("batch_id"), F.col("event_id").cast("string").alias("path"), F.when(k == 0, "processed").when(k == 1, "failed").otherwise("quarantined").alias("kind"))
    c = checkpoints.progress_of(e, e.groupBy("batch_id").agg(F.count("*").alias("total_emails")), F.lit("2024-01-31").cast("timestamp"))
    return c.select("batch_id", "processed_emails", "failed_emails", "last_processed_email", "is_complete")


@query("SELECT doc_id AS chunk_id, 'completed' AS status, 64 AS dims FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def embed_jobs(spark, sf):
    d = t(spark, sf, "documents").select(F.lit("t").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("email_id"), F.col("text").alias("content"))
    new = jobs.enqueue(d, t(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), F.lit("2024-01-01").cast("timestamp"))
    return jobs.embed(new).select("chunk_id", "status", F.size("embedding").alias("dims"))
