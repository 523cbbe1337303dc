"""Registered queries with state and timers: retries, batches, resumed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drafts, metrics, search, threading, vectors, workflow
from ..sources import mailbox, messages, versions
from ..sources.work import folder
from ..streaming import batcher, guards, resume, retries
from .catalog import _queries, query, t

#: A task fails as often as the rest of its number by 5.
_ATTEMPTS = """
WITH RECURSIVE a AS (
  SELECT event_id, 1 AS attempt, CAST(ts AS TIMESTAMP) AS h FROM events
  UNION ALL
  SELECT event_id, attempt + 1, h + to_microseconds(CAST(1000000 * least(60.0, 1.0 * 2 ** (attempt - 1)) AS BIGINT)) FROM a WHERE attempt <= event_id % 5 AND attempt < 3),
s AS (SELECT *, CASE WHEN attempt > event_id % 5 THEN 'completed' WHEN attempt = 3 THEN 'quarantined' ELSE 'retry' END AS status FROM a)
SELECT event_id, CAST(attempt AS INTEGER) AS attempt, h AS "at", status, CASE WHEN status = 'retry' THEN h + to_microseconds(CAST(1000000 * least(60.0, 1.0 * 2 ** (attempt - 1)) AS BIGINT)) END AS due FROM s
"""


def _fails(task: dict, attempt: int) -> None:
    if attempt <= task["event_id"] % 5:
        raise RuntimeError("the attempt failed")


@query(_ATTEMPTS)
def retry_rounds(spark, sf):
    return retries.retry_rounds(t(spark, sf, "events"), "event_id", "ts", lambda n: n > F.col("event_id") % 5)


@query(f"""SELECT * FROM ({_ATTEMPTS}) WHERE attempt = 1 OR "at" <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_retries(spark, sf):
    return guards.replay(spark, sf, lambda e: retries.retry_stream(e, "event_id", "ts", _fails, ["event_id"]), "append")


@query(f"""WITH x AS ({_ATTEMPTS}), w AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 16 AS wave FROM events) SELECT event_id, status, attempt AS attempts, "at" AS ended, CAST(wave AS BIGINT) AS wave FROM x JOIN w USING (event_id) WHERE status <> 'retry'""")
def ocr_queue(spark, sf):
    return retries.run_queue(t(spark, sf, "events"), "event_id", "ts", lambda n: n > F.col("event_id") % 5, slots=16)


# events are hours apart, so batches of 8 close after 12 hours here
_SIZE, _SECONDS = 8, 12 * 3600
_BATCHES = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {{where}}),
r AS (
  SELECT user_id, event_id, t, rn, 0 AS b, 1 AS n, t AS l, CASE WHEN {_SIZE} = 1 THEN 'count' END AS closed_by FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, t, rn, b, n, l, CASE WHEN n >= {_SIZE} THEN 'count' WHEN t - l >= {_SECONDS}000000 THEN 'time' END AS closed_by
  FROM (
    SELECT e.user_id, e.event_id, e.t, e.rn,
      CASE WHEN r.closed_by IS NOT NULL OR r.t + {_SECONDS}000000 < e.t THEN b + 1 ELSE b END AS b,
      CASE WHEN r.closed_by IS NOT NULL OR r.t + {_SECONDS}000000 < e.t THEN 1 ELSE n + 1 END AS n,
      CASE WHEN r.closed_by IS NOT NULL THEN r.t WHEN r.t + {_SECONDS}000000 < e.t THEN r.t + {_SECONDS}000000 ELSE l END AS l
    FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)),
g AS (SELECT user_id, b, count(*) AS jobs, arg_min(event_id, rn) AS first_id, arg_max(event_id, rn) AS last_id, max(t) AS t, max(closed_by) AS closed_by FROM r GROUP BY ALL)
SELECT user_id, CAST(b AS BIGINT) AS batch, jobs, first_id, last_id, make_timestamp(CASE WHEN closed_by IS NULL THEN t + {_SECONDS}000000 ELSE t END) AS closed_at, coalesce(closed_by, 'timer') AS closed_by FROM g
"""


@query(_BATCHES.format(where="true"))
def embedding_batches(spark, sf):
    return batcher.batches(t(spark, sf, "events"), "user_id", "ts", "event_id", _SIZE, _SECONDS)


_SEEN = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query(f"SELECT * FROM ({_BATCHES.format(where=f'ts <= {_SEEN}')}) WHERE closed_by <> 'timer' OR closed_at < {_SEEN}")
def stream_batches(spark, sf):
    return guards.replay(spark, sf, lambda e: batcher.batch_stream(e, "user_id", "ts", "event_id", _SIZE, _SECONDS), "append")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_resumed(spark, sf):
    """Events in files by type, one to a micro-batch; the first run dies between a write and its commit, the second goes on."""
    name = f"resumed-{uuid.uuid4().hex}"
    at = f"{folder(spark)}/streams/{name}/in"
    t(spark, sf, "events").select("event_id", "user_id", "event_type").repartition(4, "event_type").write.parquet(at)

    def stream():
        return spark.readStream.schema("event_id long, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(at)

    def die(epoch):
        if epoch == 1:
            raise RuntimeError("stopped before the commit")

    try:
        resume.advance(name, stream(), after_write=die)
    except Exception as stopped:  # a stream's error comes wrapped
        if "stopped before the commit" not in str(stopped):
            raise
    resume.advance(name, stream())
    return resume.written(spark, name, stream().schema)


# ---------------------------------------------------------------- threads
#: Messages of three tenants: replies and references to other messages, some of them later, in another tenant or unknown; subjects that come again.
_MAIL = """
m AS (
  SELECT user_id % 3 AS tenant_id, event_id AS seq, 'm' || event_id AS message_id, ts AS date,
    CASE WHEN event_id % 4 = 1 THEN 'm' || event_id * 7919 % (event_id + 50) END AS in_reply_to,
    CASE WHEN event_id % 4 = 2 THEN ['m' || event_id * 31 % (event_id + 200), 'm' || event_id * 17 % (event_id + 20)] ELSE [] END AS refs,
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 1 THEN 'Re: Topic ' || event_id % 400 ELSE 'Topic ' || event_id % 400 END AS subject FROM events)"""
_THREADS = f"""{_MAIL},
looks AS (
  SELECT tenant_id, seq, message_id, 0 AS k, in_reply_to AS target FROM m WHERE in_reply_to IS NOT NULL
  UNION ALL SELECT tenant_id, seq, message_id, 1, refs[1] FROM m WHERE len(refs) > 0
  UNION ALL SELECT tenant_id, seq, message_id, 2, refs[2] FROM m WHERE len(refs) > 0),
links AS (SELECT l.tenant_id, l.message_id, arg_min(l.target, k) AS up FROM looks l JOIN m ON m.tenant_id = l.tenant_id AND m.message_id = l.target AND m.seq < l.seq GROUP BY ALL),
alone AS (SELECT *, CASE WHEN subject <> '' THEN regexp_replace(lower(subject), '^re: ', '') END AS topic FROM m ANTI JOIN links USING (tenant_id, message_id)),
up AS (
  SELECT tenant_id, message_id, up FROM links
  UNION ALL SELECT tenant_id, message_id, CASE WHEN topic IS NULL THEN message_id ELSE first_value(message_id) OVER (PARTITION BY tenant_id, topic ORDER BY seq) END FROM alone),
walk AS (
  SELECT tenant_id, message_id, up FROM up
  UNION ALL SELECT w.tenant_id, w.message_id, u.up FROM walk w JOIN up u ON u.tenant_id = w.tenant_id AND u.message_id = w.up WHERE u.up <> w.up),
a AS (SELECT w.tenant_id, m.seq, w.message_id, w.up AS thread_root FROM walk w JOIN up u ON u.tenant_id = w.tenant_id AND u.message_id = w.up AND u.up = u.message_id JOIN m ON m.tenant_id = w.tenant_id AND m.message_id = w.message_id),
i AS (
  SELECT tenant_id, thread_root, count(*) AS email_count, arg_min(date, seq) AS first_date, arg_max(date, seq) AS last_date, arg_min(subject, seq) AS s,
    CASE WHEN count(*) FILTER (in_reply_to IS NOT NULL AND m.message_id <> thread_root) > 0 THEN 2 ELSE 1 END AS depth, count(*) AS breadth
  FROM a JOIN m USING (tenant_id, seq) GROUP BY ALL),
info AS (SELECT * EXCLUDE (s), CASE WHEN s = '' THEN 'no_subject' ELSE regexp_replace(lower(s), '^re: ', '') END AS subject_norm FROM i)"""


def _mail(spark, sf):
    e = F.col("event_id")
    m = lambda n: F.concat(F.lit("m"), n.cast("string"))
    topic = F.concat(F.lit("Topic "), (e % 400).cast("string"))
    return t(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("tenant_id"), e.alias("seq"), m(e).alias("message_id"), F.col("ts").alias("date"), F.when(e % 4 == 1, m(e * 7919 % (e + 50))).alias("in_reply_to"),
        F.when(e % 4 == 2, F.array(m(e * 31 % (e + 200)), m(e * 17 % (e + 20)))).otherwise(F.array().cast("array<string>")).alias("refs"),
        F.when(e % 11 == 0, "").when(e % 2 == 1, F.concat(F.lit("Re: "), topic)).otherwise(topic).alias("subject"),
    )


@query(f"WITH RECURSIVE {_THREADS} SELECT tenant_id, seq, message_id, thread_root FROM a")
def thread_links(spark, sf):
    return threading.assign(_mail(spark, sf))


@query(f"WITH RECURSIVE {_THREADS} SELECT * FROM info")
def thread_details(spark, sf):
    m = _mail(spark, sf)
    return threading.thread_info(threading.assign(m), m)


@query(f"WITH RECURSIVE {_THREADS} SELECT tenant_id, thread_root, email_count, 'subject' AS found_by FROM info WHERE subject_norm = 'topic ' || tenant_id UNION ALL SELECT DISTINCT tenant_id, thread_root, email_count, a.message_id FROM a JOIN info USING (tenant_id, thread_root) WHERE seq % 97 = 1")
def thread_lookup(spark, sf):
    m = _mail(spark, sf)
    assigned = threading.assign(m)
    info = threading.thread_info(assigned, m)
    subjects = m.select("tenant_id", F.concat(F.lit("FW: TOPIC  "), F.col("tenant_id").cast("string")).alias("subject")).distinct()
    by_subject = threading.threads_by_subject(info, subjects).select("tenant_id", "thread_root", "email_count", F.lit("subject").alias("found_by"))
    by_message = threading.thread_by_message(info, assigned, m.where("seq % 97 = 1"))
    return by_subject.unionByName(by_message.select("tenant_id", "thread_root", "email_count", F.col("message_id").alias("found_by")))


# ---------------------------------------------------------------- versions, benchmarks, attachments
@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def index_versions(spark, sf):
    """Counts of half the events, then of all, each a version; the alias is switched to the second and the first is dropped."""
    store = versions.Store(spark, f"index-{uuid.uuid4().hex}")
    counts = lambda e: e.groupBy("event_type").agg(F.count("*").alias("n"))
    e = t(spark, sf, "events").select("event_id", "event_type")
    store.create("counts", counts(e).schema)
    for part in (e.where("event_id % 2 = 0"), e):
        store.switch("counts", store.write("counts", counts(part)))
    store.retain("counts", 1)
    return store.read("counts")


@query("SELECT CAST(run AS INTEGER) AS run, event_type, round(avg(value), 9) AS mean FROM events, (SELECT unnest([1, 2]) AS run) WHERE event_id % (run + 1) = 0 GROUP BY ALL")
def benchmark_runs(spark, sf):
    """Three runs are saved; the two newest are read."""
    runs = versions.Benchmarks(spark, f"bench-{uuid.uuid4().hex}")
    for k in (1, 2, 3):
        runs.save(t(spark, sf, "events").where(F.col("event_id") % k == 0).groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("mean")))
    return runs.recent(2)


@query(
    r"""
WITH p AS (
  SELECT page_id, html, length(html) AS size_bytes,
    CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/zip' ELSE 'text/html' END AS mimetype,
    CASE WHEN page_id % 6 NOT IN (0, 2, 3) THEN html END AS native_text FROM pages),
v AS (SELECT *, mimetype <> 'application/zip' AND size_bytes <= 3000 AS ok, regexp_replace(native_text, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') AS s FROM p),
n AS (SELECT *, CASE WHEN ok THEN mimetype = 'image/png' OR native_text IS NULL OR length(s) < 50 OR (length(s) - length(regexp_replace(s, '[\p{L}\p{N} \t\n\r\f\x0B]', '', 'g'))) / greatest(1, length(s)) < 0.7 END AS needs_ocr FROM v),
o AS (SELECT *, CASE WHEN needs_ocr THEN least(page_id % 5 + 1, 3) END AS attempts, CASE WHEN needs_ocr AND page_id % 5 < 3 THEN 'page ' || page_id || ' password' END AS ocr_text FROM n),
f AS (SELECT *, coalesce(ocr_text, CASE WHEN ok AND NOT needs_ocr THEN native_text END) AS text, CASE WHEN mimetype = 'application/zip' THEN 'Unsupported mimetype: application/zip' WHEN NOT ok THEN 'Invalid attachment' WHEN needs_ocr AND ocr_text IS NULL THEN 'OCR failed' END AS error FROM o)
SELECT page_id, CASE WHEN error IS NOT NULL THEN 'workflow_failed' ELSE 'workflow_completed' END AS current_step, coalesce(needs_ocr, false) AS needs_ocr, CAST(coalesce(attempts, 0) AS INTEGER) AS attempts, error AS error_message, error IS NOT NULL AS quarantined,
  CASE WHEN text IS NOT NULL THEN 't/emails/' || page_id || '/attachments/' || url_name || '/text' END AS storage_key,
  CASE WHEN text IS NOT NULL THEN concat_ws(',', CASE WHEN contains(lower(text), 'password') THEN 'potential_password_exposure' END, CASE WHEN contains(lower(text), 'credit_card') THEN 'potential_credit_card_exposure' END, CASE WHEN contains(lower(text), 'ssn') THEN 'potential_ssn_exposure' END, CASE WHEN contains(lower(text), 'api_key') THEN 'potential_api_key_exposure' END, CASE WHEN regexp_matches(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b') THEN 'potential_credit_card_exposure' END, CASE WHEN length(text) > 10000 THEN 'content_too_large' END) END AS checks,
  CASE WHEN NOT ok THEN 'attachment_rejected,extraction_skipped,ocr_not_needed,ocr_skipped,storage_skipped,compliance_skipped,workflow_failed'
    WHEN needs_ocr THEN 'attachment_validated,' || CASE WHEN mimetype = 'image/png' THEN 'ocr_required' ELSE 'ocr_fallback' END || ',ocr_required,' || CASE WHEN ocr_text IS NULL THEN 'ocr_failed,storage_skipped,compliance_skipped,workflow_failed' ELSE 'ocr_completed,storage_completed,compliance_checked,workflow_completed' END
    ELSE 'attachment_validated,text_extracted,ocr_not_needed,ocr_skipped,storage_completed,compliance_checked,workflow_completed' END AS steps
FROM (SELECT *, 'f' || page_id % 10 AS url_name FROM f)
"""
)
def attachment_workflow(spark, sf):
    k = F.col("page_id") % 6
    kind = F.when(k == 0, "image/png").when(k == 1, "text/plain").when(k == 2, "application/pdf").when(k == 3, "application/zip").otherwise("text/html")
    tasks = t(spark, sf, "pages").select(
        "page_id", F.lit("t").alias("tenant_id"), F.col("page_id").cast("string").alias("email_id"), F.concat(F.lit("f"), (F.col("page_id") % 10).cast("string")).alias("filename"), kind.alias("mimetype"),
        F.length("html").alias("size_bytes"), F.when(~k.isin(0, 2, 3), F.col("html")).alias("native_text"),
    )
    # recognition fails as often as the rest of the page's number by 5
    read = lambda n: F.when(n > F.col("page_id") % 5, F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" password")))
    done = workflow.process(tasks, read, largest=3000)
    return done.select("page_id", "current_step", F.coalesce("needs_ocr", F.lit(False)).alias("needs_ocr"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error_message", "quarantined", "storage_key", F.array_join("compliance_checks", ",").alias("checks"), F.array_join("steps", ",").alias("steps"))


# ---------------------------------------------------------------- metrics of a window, evaluation, highlights
_LOG_SQL = """
log AS (
  SELECT user_id % 4 AS tenant_id, event_id AS query_id, repeat(event_type || ' ', event_id % 30) AS query, ts AS timestamp, value AS total_time_ms, event_type <> 'error' AS success, event_type AS search_type,
    CASE WHEN event_id % 2 = 0 THEN value / 2 ELSE 0.0 END AS bm25_time_ms, CASE WHEN event_id % 3 = 0 THEN value / 4 ELSE 0.0 END AS vector_time_ms, 0.0::DOUBLE AS fusion_time_ms,
    CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'reason ' || event_id % 3 ELSE '' END AS error_message FROM events)"""


def _log(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    return t(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("tenant_id"), e.alias("query_id"), F.expr("repeat(event_type || ' ', cast(event_id % 30 as int))").alias("query"), F.col("ts").alias("timestamp"), v.alias("total_time_ms"), (F.col("event_type") != "error").alias("success"),
        F.col("event_type").alias("search_type"), F.when(e % 2 == 0, v / 2).otherwise(0.0).alias("bm25_time_ms"), F.when(e % 3 == 0, v / 4).otherwise(0.0).alias("vector_time_ms"), F.lit(0.0).alias("fusion_time_ms"),
        F.when((F.col("event_type") == "error") & (e % 3 > 0), F.concat(F.lit("reason "), (e % 3).cast("string"))).otherwise("").alias("error_message"),
    )


@query(
    f"""
WITH {_LOG_SQL}, w AS (SELECT * FROM log WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR),
v AS (SELECT tenant_id, list_sort(list(total_time_ms)) AS v, len(list(total_time_ms)) AS n FROM w WHERE success GROUP BY 1),
q AS (SELECT tenant_id, CASE WHEN n < 20 THEN 0.0 ELSE (v[j] * (20 - d) + v[j + 1] * d) / 20 END AS p95 FROM (SELECT *, greatest(1, least((19 * (n + 1)) // 20, n - 1)) AS j, 19 * (n + 1) - greatest(1, least((19 * (n + 1)) // 20, n - 1)) * 20 AS d FROM v)),
ty AS (SELECT tenant_id, string_agg(search_type || '=' || c, ',' ORDER BY search_type) AS types FROM (SELECT tenant_id, search_type, count(*) AS c FROM w GROUP BY ALL) GROUP BY 1),
er AS (SELECT tenant_id, string_agg(error_message || '=' || c, ',' ORDER BY error_message) AS errors FROM (SELECT tenant_id, error_message, count(*) AS c FROM w WHERE NOT success AND error_message <> '' GROUP BY ALL) GROUP BY 1)
SELECT tenant_id, count(*) AS total_searches, count(*) FILTER (success) AS successful_searches, round(avg(total_time_ms) FILTER (success), 6) AS avg_time_ms, round(any_value(p95), 6) AS p95_ms,
  round(coalesce(avg(bm25_time_ms) FILTER (success AND bm25_time_ms > 0), 0), 6) AS avg_bm25_time_ms, round(coalesce(avg(vector_time_ms) FILTER (success AND vector_time_ms > 0), 0), 6) AS avg_vector_time_ms, 0.0::DOUBLE AS avg_fusion_time_ms,
  any_value(types) AS types, any_value(errors) AS errors
FROM w JOIN q USING (tenant_id) JOIN ty USING (tenant_id) JOIN er USING (tenant_id) GROUP BY tenant_id
"""
)
def perf_window(spark, sf):
    m = metrics.window_summary(_log(spark, sf), ["tenant_id"], "2024-01-20 00:00:00", "7d")
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    rounded = [F.round(c, 6).alias(c) for c in ("avg_time_ms", "p95_ms", "avg_bm25_time_ms", "avg_vector_time_ms", "avg_fusion_time_ms")]
    return m.select("tenant_id", "total_searches", "successful_searches", *rounded, told("search_types").alias("types"), told("errors").alias("errors"))


@query(f"WITH {_LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, query_id DESC) AS n FROM log) SELECT tenant_id, query_id, query[1:100] AS query, timestamp, total_time_ms, search_type, success FROM r WHERE n <= 100")
def search_export(spark, sf):
    return metrics.export_searches(_log(spark, sf), ["tenant_id"])


@query(
    """
WITH s AS (SELECT doc_id, doc_id % 11 / 10 AS grounding, doc_id % 7 / 6 AS completeness, doc_id % 5 / 4 AS tone, doc_id % 3 / 2 AS policy FROM documents)
SELECT doc_id, round(grounding * 0.3 + completeness * 0.3 + tone * 0.2 + policy * 0.2, 9) AS overall_score, round(grounding * 0.3 + completeness * 0.3 + tone * 0.2 + policy * 0.2, 9) >= 0.7 AS passes,
  concat_ws('|', CASE WHEN grounding < 0.8 THEN 'Improve factual grounding with more specific details' END, CASE WHEN completeness < 0.8 THEN 'Ensure all aspects of the query are addressed' END,
    CASE WHEN tone < 0.8 THEN 'Adjust tone to match professional logistics communication' END, CASE WHEN policy < 0.8 THEN 'Review policy compliance requirements' END) AS advice FROM s
"""
)
def eval_service(spark, sf):
    part = lambda n: F.col("doc_id") % n / (n - 1)
    scored = t(spark, sf, "documents").select("doc_id", part(11).alias("grounding"), part(7).alias("completeness"), part(5).alias("tone"), part(3).alias("policy"))
    e = drafts.service_evaluation(scored, 0.7).withColumn("overall_score", F.round("overall_score", 9))
    return e.select("doc_id", "overall_score", (F.col("overall_score") >= 0.7).alias("passes"), F.array_join("recommendations", "|").alias("advice"))


@query(
    r"""
SELECT doc_id, array_to_string([regexp_replace(x, '(?i)(ing)', '<em>\1</em>', 'g') FOR x IN regexp_extract_all(text, '(?is).{0,73}ing.{0,73}')[1:3]], '|') AS content,
  CASE WHEN contains(lower(source), 'ing') THEN regexp_replace(source, '(?i)(ing)', '<em>\1</em>', 'g') ELSE '' END AS subject
FROM documents WHERE contains(lower(text), 'ing')
"""
)
def highlight_fragments(spark, sf):
    h = search.highlights(t(spark, sf, "documents").where("contains(lower(text), 'ing')"), "ing", "source", "text")
    return h.select("doc_id", F.array_join("highlight.content", "|").alias("content"), F.array_join("highlight.subject", "|").alias("subject"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 4 = 1 AND user_id = 5 AND event_id % 2 = 0 AND event_type IN ('click', 'view')")
def search_filters_all(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 4).alias("tenant_id"), F.col("user_id").alias("thread_id"), (F.col("event_id") % 2 == 0).alias("has_attachments"), F.array("event_type").alias("attachment_types"))
    return search.search_filters(e, 1, {"thread_id": 5, "has_attachments": True, "attachment_types": ["click", "view"], "unknown": 1}).select("event_id", "user_id")


@query("SELECT '<' || conv_id || '-' || turn || '@x.org>' AS message_id, role AS subject, md5(regexp_replace(text, '[\\r\\n]+$', '')) AS body FROM conversations")
def mailbox_messages(spark, sf):
    """Conversations as mailboxes, written by Spark, read back and parsed."""
    at = f"{folder(spark)}/mail-{uuid.uuid4().hex}"
    c = t(spark, sf, "conversations")
    mid = F.concat(F.lit("<"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit("@x.org>"))
    content = F.concat(F.lit("Message-ID: "), mid, F.lit("\nSubject: "), F.col("role"), F.lit("\n\n"), F.col("text"))
    mailbox.write(c.select(F.lit("a@x.org").alias("sender"), F.lit("2024-01-01").cast("timestamp").alias("date"), content.alias("content")), at, "sender", "date", "content")
    got = messages.parse_messages(mailbox.read(spark, at, "*.txt"))
    return got.select("message_id", "subject", F.md5(F.encode(F.regexp_replace("body", "[\\r\\n]+$", ""), "UTF-8")).alias("body"))


@query()  # what is found depends on the cells; its recall is measured in a test
def vector_index_topk(spark, sf):
    v, q = _queries(spark, sf)
    centers = vectors.fit(v, 16)
    return vectors.search_index(vectors.index(v, centers), centers, q, probes=12)
