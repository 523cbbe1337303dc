"""Registered queries over the driver's tables, each beside the SQL that must give the same rows.

Stand-ins: ``documents`` are message bodies (source = tenant, doc_id = arrival
order), ``pages`` HTML bodies, ``conversations`` threads, ``events`` the search
log (event_type = outcome, value = milliseconds), ``embeddings`` the vector store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as X
from ..operators import attachments, chunking, dedup, drafts, fusion, metrics, near, search, threading
from ..sources import messages, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = X.WS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(c: str) -> str:
    return _strip(rf"regexp_replace({c}, '{WS}+', ' ', 'g')")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


WORDS_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
NORM_SQL = _strip(rf"regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{WS}*\n', chr(10) || chr(10), 'g')")


# ---------------------------------------------------------------- normalization
@query(f"SELECT doc_id, {NORM_SQL} AS normalized FROM documents")
def plain_normalize(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.normalize_plain(F.col("text")).alias("normalized"))


@query("SELECT page_id, " + _collapse(r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[a-zA-Z]+;', ' ', 'g')") + " AS text FROM pages")
def html_strip(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


_VISIBLE = _collapse(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g')")


@query(f"SELECT page_id, {_VISIBLE} AS text FROM pages")
def html_visible_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


_LINE = "(?i:^(" + "|".join(X.SIGNATURE_LINES) + ")$)|^(" + "|".join(X.QUOTE_STARTS) + ")"


@query(
    f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: regexp_matches({_strip('x')}, '{_LINE}')), true) AS cut FROM l)
SELECT doc_id, {_strip("array_to_string(CASE WHEN coalesce(cut, 0) > 0 THEN lines[1:cut - 1] ELSE lines END, chr(10))")} AS body FROM f
"""
)
def strip_signature_quote(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.strip_signature_and_quotes(F.col("text")).alias("body"))


@query(
    f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format(c='text')} AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_list(X.ENGLISH_WORDS)}, x))) AS en,
      len(list_filter(w, lambda x: list_contains({_list(X.SPANISH_WORDS)}, x))) AS es,
      len(list_filter(w, lambda x: list_contains({_list(X.FRENCH_WORDS)}, x))) AS fr FROM w)
SELECT doc_id, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > fr THEN 'es' WHEN fr > 0 THEN 'fr' ELSE 'en' END AS language FROM c
"""
)
def lang_detect(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query(
    rf"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length({_strip('x')}) > 0)) AS sentences,
  len(list_filter(regexp_split_to_array(text, '\n{WS}*\n'), lambda x: length({_strip('x')}) > 0)) AS paragraphs,
  greatest(1, length(text) // 4) AS tokens
FROM documents
"""
)
def text_stats(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", X.count_words(c).alias("words"), X.count_sentences(c).alias("sentences"), X.count_paragraphs(c).alias("paragraphs"), X.estimate_tokens(c).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, strlen(text) AS bytes, 'email_' || sha256(CAST(doc_id AS VARCHAR))[1:16] AS email_id FROM documents")
def content_hash(spark, sf):
    c = F.encode("text", "UTF-8")
    return t(spark, sf, "documents").select("doc_id", F.sha2(c, 256).alias("sha"), F.md5(c).alias("md5"), F.octet_length("text").cast("long").alias("bytes"), messages.email_id(F.col("doc_id").cast("string")).alias("email_id"))


# ---------------------------------------------------------------- duplicates
@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS reference_count, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def exact_dedup(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", dedup.content_hash(F.col("text")).alias("content_hash"))
    return dedup.exact_duplicates(d, "doc_id").select("doc_id", "first_id", "reference_count", "is_duplicate")


@query(
    f"""
WITH h AS (SELECT source, sha256({NORM_SQL}) AS h, count(*) AS refs FROM documents GROUP BY ALL)
SELECT source, CAST(sum(refs) AS BIGINT) AS total_content, count(*) AS unique_content, count(*) FILTER (refs > 1) AS duplicate_content,
       round((sum(refs) - count(*)) / sum(refs), 9) AS dedup_ratio
FROM h GROUP BY source
"""
)
def dedup_stats(spark, sf):
    d = t(spark, sf, "documents").select("source", dedup.content_hash(X.normalize_plain(F.col("text"))).alias("content_hash"))
    return dedup.dedup_stats(d, ["source"]).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


@query(
    "WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f, count(*) OVER (PARTITION BY sha256(text)) AS n, sha256(text) AS h FROM documents) "
    "SELECT doc_id, h AS content_hash, 'exact' AS duplicate_type, f AS original_id, 1.0::DOUBLE AS similarity_score, n AS reference_count FROM m WHERE doc_id <> f"
)
def dedup_lineage(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", dedup.content_hash(F.col("text")).alias("content_hash"))
    return dedup.lineage(dedup.exact_duplicates(d, "doc_id"), "doc_id")


_ALL_FEATURES_SQL = (
    rf"list_filter({WORDS_SQL.format(c=r'''regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[^\p{L}\p{N}_ \t\n\r\f\x0B]', ' ', 'g')''')}, "
    rf"lambda x: length(x) > 2 AND NOT list_contains({_list(X.STOP_WORDS)}, x))"
)
_FEATURES_SQL = f"list_slice({_ALL_FEATURES_SQL}, 1, 1000)"
_SIMHASH_SQL = f"""
words AS (SELECT doc_id, unnest({_FEATURES_SQL}) AS word FROM documents),
counted AS (SELECT doc_id, word, count(*) AS n, CAST('0x' || md5(word)[1:15] AS BIGINT) AS h FROM words GROUP BY ALL),
votes AS (SELECT doc_id, i, sum((((h >> i) & 1) * 2 - 1) * n) AS v FROM counted, range(0, 60) r(i) GROUP BY doc_id, i),
hashes AS (SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN v > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END), 0) AS BIGINT) AS simhash
           FROM documents d LEFT JOIN votes USING (doc_id) GROUP BY d.doc_id)
"""


@query(f"WITH {_SIMHASH_SQL.replace(_FEATURES_SQL, _ALL_FEATURES_SQL)} SELECT doc_id, simhash FROM hashes")
def simhash_md5(spark, sf):
    return dedup.simhash(t(spark, sf, "documents"), "doc_id", "text", limit=None)


@query(
    f"""WITH {_SIMHASH_SQL}, u AS (SELECT DISTINCT simhash FROM hashes)
SELECT a.simhash AS x, b.simhash AS y, bit_count(xor(a.simhash, b.simhash)) AS distance FROM u a JOIN u b ON a.simhash < b.simhash
WHERE bit_count(xor(a.simhash, b.simhash)) <= 9"""
)
def near_dup_pairs(spark, sf):
    return dedup.near_duplicate_pairs(dedup.simhash(t(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query(
    f"""WITH RECURSIVE {_SIMHASH_SQL},
n AS (SELECT min(doc_id) AS node, simhash FROM hashes JOIN documents USING (doc_id) WHERE length({_strip('text')}) >= 100 GROUP BY simhash),
o AS MATERIALIZED (SELECT node, simhash, row_number() OVER (ORDER BY node) AS i FROM n),
g AS (
  SELECT 0 AS i, CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS original, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS sims
  UNION ALL
  SELECT i, node, original, CASE WHEN original IS NULL THEN list_append(ids, node) ELSE ids END, CASE WHEN original IS NULL THEN list_append(sims, simhash) ELSE sims END
  FROM (SELECT o.i, o.node, o.simhash, g.ids, g.sims, ids[list_position(list_transform(g.sims, lambda s: bit_count(xor(s, o.simhash)) <= 9), true)] AS original FROM g JOIN o ON o.i = g.i + 1))
SELECT node, original IS NULL AS leader, coalesce(original, -1) AS original FROM g WHERE i > 0"""
)
def near_dup_resolved(spark, sf):
    d = dedup.near_candidates(t(spark, sf, "documents"), "text")
    h = dedup.simhash(d, "doc_id", "text").groupBy("simhash").agg(F.min("doc_id").alias("id"))
    return near.resolve(h, dedup.near_masks(), 9).withColumn("original", F.coalesce("original", F.lit(-1)))


_MINHASH_SQL = f"""
words AS (SELECT DISTINCT doc_id, unnest({_FEATURES_SQL}) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || md5(word)[1:7] AS BIGINT) AS h FROM words),
m AS (SELECT doc_id, i, min(((7919 * (i + 1) + 1) * h + 104729 * (i + 1)) % 1000000007) AS v FROM h, range(0, 128) r(i) GROUP BY doc_id, i)
"""


@query(f"WITH {_MINHASH_SQL} SELECT doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS signature FROM m GROUP BY doc_id")
def minhash_signature(spark, sf):
    s = dedup.minhash(t(spark, sf, "documents"), "doc_id", "text")
    return s.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(
    f"""WITH {_MINHASH_SQL}, s AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM m GROUP BY doc_id),
d AS (SELECT sig, min(doc_id) AS id FROM s GROUP BY sig),
k AS (SELECT id, n, sig[4 * n + 1 : 4 * n + 4] AS band FROM d, range(0, 32) r(n)),
p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.n = y.n AND x.band = y.band AND x.id < y.id)
SELECT a, b, len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0::DOUBLE AS similarity FROM p JOIN d x ON x.id = a JOIN d y ON y.id = b"""
)
def minhash_similarity(spark, sf):
    return dedup.minhash_pairs(dedup.minhash(t(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def idempotent_antijoin(spark, sf):
    return dedup.drop_processed(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), ["doc_id"])


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 3 DAYS")
def ttl_cleanup(spark, sf):
    return dedup.expire(t(spark, sf, "events"), "ts", "2024-01-30 00:00:00", 3).select("user_id").distinct()


# ---------------------------------------------------------------- chunks
_SENT_SQL = f"list_transform(list_filter(list_transform(regexp_split_to_array({_collapse('text')}, '[.!?]+{WS}+'), lambda x: {_strip('x')}), lambda x: length(x) > 0), lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END)"


@query(f"SELECT doc_id, len(s) AS sentences, array_to_string(s, '|') AS joined FROM (SELECT doc_id, {_SENT_SQL} AS s FROM documents)")
def sentence_split(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_join("s", "|").alias("joined"))


@query(f"SELECT doc_id, CASE WHEN length({_collapse('text')}) = 0 THEN 0 ELSE len(string_split({_collapse('text')}, ' ')) END AS tokens FROM documents")
def token_count(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.count_blank_separated(F.col("text")).alias("tokens"))


_CHUNK_SQL = f"""
RECURSIVE s AS (SELECT doc_id, {_SENT_SQL} AS l FROM documents),
fold AS (
  SELECT doc_id, l, 0 AS i, '' AS cur, CAST(NULL AS VARCHAR) AS emitted FROM s WHERE len(l) > 0
  UNION ALL
  SELECT doc_id, l, i + 1,
    CASE WHEN i = len(l) THEN '' WHEN length(cur) > 0 AND length(cur) + length(l[i + 1]) > 1000 THEN right(cur, 200) || l[i + 1] ELSE cur || l[i + 1] END,
    CASE WHEN i = len(l) THEN cur WHEN length(cur) > 0 AND length(cur) + length(l[i + 1]) > 1000 THEN cur END
  FROM fold WHERE i <= len(l)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, emitted AS content FROM fold WHERE emitted IS NOT NULL)
"""


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, doc_id || '_' || chunk_index || '_' || sha256(content)[1:8] AS chunk_uid, content FROM chunks")
def chunk_fold(spark, sf):
    return chunking.create_chunks(t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "chunk_uid", "content")


@query(
    f"""WITH {_CHUNK_SQL}, k AS (SELECT doc_id, len(string_split({_collapse('content')}, ' ')) AS n FROM chunks)
SELECT count(*) AS total_chunks, count(DISTINCT doc_id) AS emails_with_chunks, round(count(*) / count(DISTINCT doc_id), 9) AS avg_chunks_per_email,
       round(avg(n), 9) AS avg_tokens, max(n) AS max_tokens, min(n) AS min_tokens FROM k"""
)
def chunk_stats(spark, sf):
    s = chunking.chunk_stats(chunking.create_chunks(t(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return s.withColumn("avg_tokens", F.round("avg_tokens", 9)).withColumn("avg_chunks_per_email", F.round("avg_chunks_per_email", 9))


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, count(*) AS chunks, CAST(sum(CASE WHEN length({_collapse('content')}) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, bool_and(length({_collapse('content')}) > 0) AS all_valid FROM chunks GROUP BY doc_id")
def chunk_validate(spark, sf):
    return chunking.validate_chunks(chunking.create_chunks(t(spark, sf, "documents"), "doc_id", "text"), "doc_id")


# ---------------------------------------------------------------- threads
@query(
    rf"""
WITH s AS (SELECT conv_id, turn, (CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END) || string_split(text, chr(10))[1] AS subject FROM conversations),
n AS (SELECT conv_id, turn, {_strip("regexp_replace(" + _collapse("regexp_replace(lower(subject), '^(re|fw|fwd|fyi) ?:', '')") + ", '[^" + chr(92) + "p{L}" + chr(92) + "p{N}_ ]', '', 'g')")} AS s FROM s)
SELECT conv_id, turn, CASE WHEN length(s) = 0 THEN 'no_subject' ELSE s END AS subject_norm FROM n
"""
)
def subject_normalize(spark, sf):
    c = t(spark, sf, "conversations")
    subject = F.concat(F.when(F.col("turn") > 0, "Re: ").otherwise(""), F.split("text", "\n")[0])
    return c.select("conv_id", "turn", X.normalize_subject(subject).alias("subject_norm"))


def _thread_messages(spark, sf) -> DataFrame:
    c = t(spark, sf, "conversations")
    mid = lambda n: F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string"))
    return c.select(
        F.col("conv_id").alias("thread_id"), "turn", "role", mid(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, mid(F.col("turn") - 1)).alias("in_reply_to"),
        F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") - 1), lambda k: mid(k))).otherwise(F.array().cast("array<string>")).alias("refs"), F.col("text").alias("subject"),
    )


@query(
    """
WITH p AS (SELECT conv_id, count(*) AS b, CASE WHEN max(turn) > 0 THEN 2 ELSE 1 END AS d FROM conversations GROUP BY 1)
SELECT count(*) AS threads, CAST(sum(b) AS BIGINT) AS messages, round(avg(d), 9) AS avg_depth, max(d) AS max_depth, round(avg(b), 9) AS avg_breadth, max(b) AS max_breadth FROM p
"""
)
def thread_stats(spark, sf):
    m = _thread_messages(spark, sf).withColumn("is_reply", F.col("in_reply_to").isNotNull())
    s = threading.thread_stats(m)
    return s.withColumn("avg_depth", F.round("avg_depth", 9)).withColumn("avg_breadth", F.round("avg_breadth", 9))


@query("SELECT conv_id || '-' || turn AS message_id, turn > 0 AS is_reply, regexp_matches(lower(text), '^(fwd:|fw:|forward:)') AS is_forward, CAST(turn AS INTEGER) AS level FROM conversations")
def thread_position(spark, sf):
    m = _thread_messages(spark, sf)
    return m.select("message_id", threading.position(F.col("subject"), F.col("in_reply_to"), F.col("refs")).alias("p")).select("message_id", "p.*")


@query("SELECT conv_id || '-' || turn AS message_id, CASE WHEN role = 'system' THEN 'missing message id' ELSE '' END AS problems FROM conversations")
def thread_consistency(spark, sf):
    m = _thread_messages(spark, sf)
    ts = F.lit("2024-01-01").cast("timestamp")
    mid = F.when(F.col("role") != "system", F.col("message_id"))
    return m.select("message_id", F.array_join(threading.consistency(mid, F.col("in_reply_to"), F.col("refs"), ts, ts), ",").alias("problems"))


@query("SELECT conv_id, turn, conv_id || '-0' AS thread_root FROM conversations")
def thread_assign(spark, sf):
    m = _thread_messages(spark, sf)
    k = m.select(F.col("thread_id").alias("tenant_id"), F.col("turn").alias("seq"), "message_id", "in_reply_to", "refs", "subject")
    return threading.assign(k).select(F.col("tenant_id").alias("conv_id"), F.col("seq").alias("turn"), "thread_root")


@query("SELECT doc_id, 'thread_' || sha256(CAST(doc_id AS VARCHAR))[1:16] AS thread_id FROM documents")
def thread_id(spark, sf):
    return t(spark, sf, "documents").select("doc_id", threading.thread_id(F.col("doc_id").cast("string"), F.lit("x")).alias("thread_id"))


# ---------------------------------------------------------------- headers and storage
@query(
    """
SELECT c_custkey, 'Customer ' || c_custkey || ' <' || lower(c_name) || '@' || lower(c_mktsegment) || '.example.com>|plain@example.com' AS joined FROM customer
"""
)
def address_list(spark, sf):
    head = F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" <"), F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com> , ,plain@example.com"))
    a = X.address_list(head)
    full = F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" <"), a[0], F.lit(">"))
    return t(spark, sf, "customer").select("c_custkey", F.concat_ws("|", full, F.slice(a, 2, 10)).alias("joined"))


@query("SELECT c_custkey, '<' || md5('a@' || lower(c_mktsegment) || '.org' || '2024-01-01' || c_name) || '@' || lower(c_mktsegment) || '.org>' AS message_id FROM customer")
def message_id_md5(spark, sf):
    sender = F.concat(F.lit("a@"), F.lower("c_mktsegment"), F.lit(".org"))
    return t(spark, sf, "customer").select("c_custkey", messages.message_id(sender, F.lit("2024-01-01"), F.col("c_name")).alias("message_id"))


@query(
    """
SELECT o_orderkey, 'tenant-' || o_custkey || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/t/e/raw/' || regexp_replace(o_orderpriority || ':a*.eml', '[\\\\/:*?"<>|]', '_', 'g') AS path,
  true AS valid, 'tenant-' || o_custkey AS tenant FROM orders
"""
)
def storage_paths(spark, sf):
    p = storage.object_path(F.concat(F.lit("tenant-"), F.col("o_custkey").cast("string")), F.col("o_orderdate"), F.lit("t"), F.lit("e"), F.lit("raw"), F.concat("o_orderpriority", F.lit(":a*.eml")))
    o = t(spark, sf, "orders").select("o_orderkey", p.alias("path"))
    return o.select("o_orderkey", "path", storage.is_valid_path(F.col("path")).alias("valid"), storage.parse_path(F.col("path"))["tenant"].alias("tenant"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet FROM documents")
def email_snippet(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.snippet(F.col("text"), 200).alias("snippet"))


_TYPE_SQL = "CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/zip' ELSE 'application/pdf' END"


def _typed_pages(spark, sf):
    kind = F.when(F.col("page_id") % 4 == 0, "text/html").when(F.col("page_id") % 4 == 1, "image/png").when(F.col("page_id") % 4 == 2, "application/zip").otherwise("application/pdf")
    return t(spark, sf, "pages").select("page_id", "html", kind.alias("mimetype"), F.octet_length("html").alias("size_bytes"))


@query(f"SELECT page_id, mimetype <> 'application/zip' AS valid FROM (SELECT page_id, {_TYPE_SQL} AS mimetype FROM pages)")
def attachment_gate(spark, sf):
    return _typed_pages(spark, sf).select("page_id", attachments.is_valid(F.col("mimetype"), F.col("size_bytes")).alias("valid"))


@query(
    f"""
WITH p AS (SELECT page_id, {_TYPE_SQL} AS mimetype, CASE WHEN length(html) = 0 THEN 0.0 ELSE (length(html) - length(regexp_replace(html, '[ -~]', '', 'g'))) / length(html) END AS r FROM pages)
SELECT page_id, round(r, 9) AS ratio, mimetype LIKE 'image/%' OR (mimetype = 'application/pdf' AND r < 0.1) AS ocr FROM p
"""
)
def text_ratio(spark, sf):
    p = _typed_pages(spark, sf)
    return p.select("page_id", F.round(attachments.text_ratio(F.col("html")), 9).alias("ratio"), attachments.requires_ocr(F.col("mimetype"), F.col("html")).alias("ocr"))


@query(
    rf"""
WITH s AS (SELECT doc_id, {_strip('text')} AS s FROM documents)
SELECT doc_id, length(s) < 50 OR (length(s) - length(regexp_replace(s, '[\p{{L}}\p{{N}} \t\n\r\f\x0B]', '', 'g'))) / greatest(1, length(s)) < 0.7 AS needs_ocr FROM s
"""
)
def needs_ocr(spark, sf):
    return t(spark, sf, "documents").select("doc_id", attachments.needs_ocr(F.lit(True), F.col("text")).alias("needs_ocr"))


@query("SELECT doc_id, '[REDACTED: ' || length(text) || ' chars]' AS redacted, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN length(text) > 0 THEN 'completed' ELSE 'incomplete' END AS status FROM documents")
def ocr_status(spark, sf):
    d = t(spark, sf, "documents")
    error = F.when(F.col("doc_id") % 7 == 0, "e").otherwise("")
    return d.select("doc_id", attachments.redact(F.col("text")).alias("redacted"), attachments.final_status(error, F.col("text")).alias("status"))


@query(
    f"""
SELECT page_id, mimetype, mimetype = 'text/html' AS success, CASE WHEN mimetype = 'text/html' THEN text ELSE '' END AS text
FROM (SELECT page_id, html, {_TYPE_SQL} AS mimetype, {_collapse(r"replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} AS text FROM pages)
"""
)
def extract_documents(spark, sf):
    p = _typed_pages(spark, sf).select("page_id", "mimetype", F.encode("html", "UTF-8").alias("content"))
    return attachments.extract_text(p)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (event_type <> 'error' AND value IS NOT NULL) AS value FROM events GROUP BY user_id")
def patch_fold(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return attachments.fold_patches(e, "user_id", "event_id", ["event_type", "value"])


@query("SELECT DISTINCT event_type FROM events EXCEPT SELECT unnest(['click', 'view'])")
def key_difference(spark, sf):
    e = t(spark, sf, "events").agg(F.collect_set("event_type").alias("k"))
    return e.select(F.explode(attachments.unknown_keys(F.col("k"), ["click", "view"])).alias("event_type"))


# ---------------------------------------------------------------- search
@query("SELECT user_id, event_id, value FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def search_filters(spark, sf):
    e = t(spark, sf, "events").withColumnsRenamed({"user_id": "tenant_id", "ts": "sent_at"})
    e = search.search_filters(e, 7, {"sent_at": {"gte": "2024-01-05", "lte": "2024-01-20"}})
    return e.select(F.col("tenant_id").alias("user_id"), "event_id", "value")


@query("SELECT user_id, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def thread_terms_agg(spark, sf):
    return search.terms_facet(t(spark, sf, "events"), "user_id")


@query(
    """
SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-30') AS last_day,
       count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY) AS last_week,
       count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS last_month FROM events
"""
)
def date_range_agg(spark, sf):
    return search.date_range_facet(t(spark, sf, "events"), "ts", "2024-01-30 00:00:00")


@query(
    """
WITH h AS (SELECT b.item_id AS query_id, doc_id, CASE WHEN starts_with(lower(text_), lower(b.text)) THEN 0.9 ELSE 0.7 END AS score
           FROM (SELECT doc_id, text AS text_ FROM documents) d JOIN benchmark b ON contains(lower(d.text_), lower(b.text))),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rn FROM h)
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank FROM n WHERE rn <= 10
"""
)
def sql_text_search(spark, sf):
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = t(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("newest"))
    return search.text_search(d, q, "doc_id", "text", "newest").select("query_id", "doc_id", "score", "rank")


@query(
    f"""
WITH q AS (SELECT item_id, {_strip('text')} AS q FROM benchmark),
p AS (SELECT item_id, q, string_split(regexp_replace(q, '{WS}+', ' ', 'g'), ' ') AS w FROM q)
SELECT item_id, NOT (length(q) = 0 OR list_contains({_list(search.WILDCARDS)}, q) OR len(list_filter({_list(search.DANGEROUS)}, lambda x: contains(lower(q), x))) > 0) AS is_valid,
  CASE WHEN length(q) > 500 THEN 1 ELSE 0 END + CASE WHEN len(w) < 2 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: NOT list_contains({_list(search.GENERIC)}, lower(x)))) = 0 THEN 1 ELSE 0 END AS warnings
FROM p
"""
)
def query_validate(spark, sf):
    ok, warn = search.validate_query(F.col("text"))
    return t(spark, sf, "benchmark").select("item_id", ok.alias("is_valid"), F.size(warn).alias("warnings"))


_ANALYZE = "list_filter(" + WORDS_SQL + ", lambda x: NOT list_contains(" + _list(search.ANALYZER_STOP_WORDS) + ", x))"
_BM25_SQL = f"""
d AS (SELECT doc_id, {_ANALYZE.format(c='text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_ANALYZE.format(c='text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits)
"""


def _bm25(spark, sf, k=10):
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(t(spark, sf, "documents"), q, "doc_id", "text", "query_id", "query", k)


@query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# the SQL engine counts edits in bytes: letters of the tables beyond ASCII are written as capitals, which lower-cased words lack
@query(
    f"""
WITH w AS (SELECT DISTINCT translate(x, 'óñíêéèçößäü', 'ABCDEFGHIJK') AS a, x FROM (SELECT unnest({WORDS_SQL.format(c='text')}) AS x FROM documents)),
q AS (SELECT DISTINCT translate(x, 'óñíêéèçößäü', 'ABCDEFGHIJK') AS a, x FROM (SELECT unnest({{analyzed}}) AS x FROM benchmark)),
e AS (SELECT q.x AS term, w.x AS word, levenshtein(q.a, w.a) AS edits, CASE WHEN length(q.x) <= 2 THEN 0 WHEN length(q.x) <= 5 THEN 1 ELSE 2 END AS allowed FROM q JOIN w ON abs(length(q.a) - length(w.a)) <= 2)
SELECT term, word, CAST(edits AS INTEGER) AS edits FROM e WHERE edits <= allowed
""".replace("{analyzed}", _ANALYZE.format(c="text"))
)
def fuzzy_terms(spark, sf):
    v = t(spark, sf, "documents").select(F.explode(X.words(F.lower("text"))).alias("word")).distinct()
    q = t(spark, sf, "benchmark").select(F.explode(search.analyze(F.col("text"))).alias("term")).distinct()
    return search.fuzzy_terms(v, q)


_VEC_SQL = """
qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
vh AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, qv WHERE vec_id <> query_id)
"""


def _queries(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {_VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vh WHERE score >= 0.1) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark, sf):
    return search.vector_top_k(*_queries(spark, sf), threshold=0.1).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vh) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND score >= 0.25")
def vector_topk_threshold_after(spark, sf):
    return search.vector_top_k(*_queries(spark, sf), threshold=0.25, after=True).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- fusion
_LISTS_SQL = """
a AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r1, value AS s1 FROM events),
b AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r2, value AS s2 FROM events),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, r1, r2, s1, s2,
        1.0::DOUBLE / (60 + coalesce(r1, 60)) + 1.0::DOUBLE / (60 + coalesce(r2, 60)) AS fs
      FROM (SELECT * FROM a WHERE r1 < 20) a FULL OUTER JOIN (SELECT * FROM b WHERE r2 < 20) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 12) DESC, chunk_id) AS rank FROM f)
"""


def _lists(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "value", "ts", "event_type")
    a = search.top_k(e, "query_id", [F.desc("value"), F.col("chunk_id")], 20)
    b = search.top_k(e, "query_id", [F.col("ts"), F.col("chunk_id")], 20)
    pick = lambda d: d.select("query_id", "chunk_id", "rank", F.col("value").alias("score"))
    return pick(a), pick(b)


@query(
    f"""WITH {_LISTS_SQL} SELECT query_id, chunk_id, round(fs, 9) AS fused_score, concat_ws(',', CASE WHEN r1 IS NOT NULL THEN 'bm25' END, CASE WHEN r2 IS NOT NULL THEN 'vector' END) AS sources,
coalesce(s1, 0.0) AS bm25_score, coalesce(s2, 0.0) AS vector_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def rrf_fusion(spark, sf):
    f = fusion.fused_top(*_lists(spark, sf), 10)
    return f.withColumn("fused_score", F.round("fused_score", 9)).withColumn("sources", F.array_join("sources", ","))


@query(
    """
SELECT a.conv_id, array_to_string(list_slice(list_distinct_ordered, 1, 3), '|') AS highlights FROM (
  SELECT conv_id, [x FOR x, i IN l IF list_position(l, x) = i] AS list_distinct_ordered
  FROM (SELECT conv_id, list(role ORDER BY turn) || ['user', 'tool'] AS l FROM conversations GROUP BY conv_id)) a
"""
)
def rrf_merge_highlights(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    a = F.transform("l", lambda x: x["role"])
    return c.select("conv_id", F.array_join(fusion.merge_highlights(a, F.array(F.lit("user"), F.lit("tool"))), "|").alias("highlights"))


@query(
    f"""WITH {_LISTS_SQL}, top AS (SELECT *, abs(sin(chunk_id)) AS rr FROM r WHERE rank <= 100),
z AS (SELECT query_id, chunk_id, round(0.7 * fs + 0.3 * rr, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, chunk_id) AS rank FROM top)
SELECT query_id, chunk_id, final_score, CAST(rank AS INTEGER) AS rank FROM z"""
)
def rerank(spark, sf):
    r = fusion.rerank(fusion.fuse(*_lists(spark, sf)), F.abs(F.sin(F.col("chunk_id").cast("double"))))
    return r.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


@query(
    """
WITH g AS (SELECT event_type, count(*) AS n, avg(value / 1000) AS avg_time, list_sort(list(value / 1000)) AS v, max(value / 1000) AS max_time FROM events GROUP BY 1)
SELECT event_type, n, round(avg_time, 9) AS avg_time, v[CAST(floor(n * 0.95) AS INTEGER) + 1] AS p95, max_time,
  CASE WHEN avg_time < 0.1 THEN 'excellent' WHEN avg_time < 0.5 THEN 'good' WHEN avg_time < 1 THEN 'fair' ELSE 'poor' END AS grade FROM g
"""
)
def fusion_performance(spark, sf):
    e = t(spark, sf, "events").select("event_type", (F.col("value") / 1000).alias("s"))
    return fusion.performance(e, ["event_type"], "s").withColumn("avg_time", F.round("avg_time", 9))


# ---------------------------------------------------------------- metrics
_SCORES_SQL = "s AS (SELECT user_id, list(value / 100 ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"


def _scores(spark, sf):
    e = t(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")).withColumn("s", F.col("value") / 100)
    return metrics.score_lists(e, ["user_id"], "o", "s")


def _hit(k: int) -> str:
    return f"len(list_filter(v[1:{k}], lambda x: x > 0.5)) / least({k}, len(v))"


@query(f"WITH {_SCORES_SQL} SELECT user_id, " + ", ".join(f"{_hit(k)} AS hit_at_{k}" for k in (1, 3, 5, 10)) + " FROM s")
def hit_at_k(spark, sf):
    return _scores(spark, sf).select("user_id", *[N.hit_at(F.col("scores"), k).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)])


_MRR = "CASE WHEN list_position(list_transform(v, lambda x: x > 0.5), true) > 0 THEN 1.0::DOUBLE / list_position(list_transform(v, lambda x: x > 0.5), true) ELSE 0 END"
_NDCG = (
    "list_sum([x / i FOR x, i IN v[1:10]]) / list_sum([x / i FOR x, i IN list_reverse_sort(v[1:10])])"
)


@query(f"WITH {_SCORES_SQL} SELECT user_id, CAST({_MRR} AS DOUBLE) AS mrr FROM s")
def mrr(spark, sf):
    return _scores(spark, sf).select("user_id", N.reciprocal_rank(F.col("scores")).alias("mrr"))


@query(f"WITH {_SCORES_SQL} SELECT user_id, round({_NDCG}, 9) AS ndcg FROM s")
def ndcg_linear(spark, sf):
    return _scores(spark, sf).select("user_id", F.round(N.ndcg_linear(F.col("scores"), 10), 9).alias("ndcg"))


@query(
    f"""WITH {_SCORES_SQL}, c AS (SELECT user_id, len(list_filter(v[1:5], lambda x: x > 0.5)) AS k, len(list_filter(v, lambda x: x > 0.5)) AS a FROM s),
r AS (SELECT user_id, k / 5.0::DOUBLE AS p, CASE WHEN a > 0 THEN k / a ELSE 0.0 END AS r FROM c)
SELECT user_id, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM r"""
)
def prf_at_k(spark, sf):
    p, r, f1 = N.precision_recall_f1(F.col("scores"), 5)
    return _scores(spark, sf).select("user_id", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


_Q_EXCL = "CASE WHEN n < {p} THEN 0.0 ELSE (v[j{p}] * ({p} - d{p}) + v[j{p} + 1] * d{p}) / {p} END"
_PERF_SQL = """
g AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS bad,
      avg(value) FILTER (event_type <> 'error') AS m, coalesce(list_sort(list(value) FILTER (event_type <> 'error')), []) AS v FROM events GROUP BY user_id),
n AS (SELECT *, len(v) AS n FROM g),
j AS (SELECT *, greatest(1, least((19 * (n + 1)) // 20, n - 1)) AS j20, greatest(1, least((99 * (n + 1)) // 100, n - 1)) AS j100 FROM n),
e AS (SELECT *, 19 * (n + 1) - j20 * 20 AS d20, 99 * (n + 1) - j100 * 100 AS d100 FROM j),
perf AS (SELECT user_id, total AS total_searches, ok AS successful_searches, bad AS failed_searches, coalesce(m, 0.0) AS avg_time_ms, """ + _Q_EXCL.format(p=20) + " AS p95_ms, " + _Q_EXCL.format(p=100) + " AS p99_ms FROM e)"


def _performance(spark, sf):
    e = t(spark, sf, "events").withColumn("success", F.col("event_type") != "error")
    return metrics.performance_summary(e, ["user_id"], "value")


@query(f"WITH {_PERF_SQL} SELECT user_id, total_searches, successful_searches, failed_searches, round(avg_time_ms, 6) AS avg_time_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms FROM perf")
def perf_summary(spark, sf):
    p = _performance(spark, sf)
    for c in ("avg_time_ms", "p95_ms", "p99_ms"):
        p = p.withColumn(c, F.round(c, 6))
    return p


@query(f"WITH {_PERF_SQL} SELECT count(*) AS tenants, CAST(sum(total_searches) AS BIGINT) AS total_searches, CAST(sum(successful_searches) AS BIGINT) AS successful_searches, round(avg(round(avg_time_ms, 2)), 6) AS avg_time_ms FROM perf")
def global_metrics(spark, sf):
    return metrics.global_metrics(_performance(spark, sf)).withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def type_distribution(spark, sf):
    return metrics.distribution(t(spark, sf, "events"), ["user_id"], "event_type")


@query("WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, v[CAST(floor(n * 0.95) AS INTEGER) + 1] AS p95 FROM g")
def p95_nearest(spark, sf):
    return metrics.ocr_latency_p95(t(spark, sf, "events"), ["event_type"], "value")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1")
def p95_linear(spark, sf):
    return metrics.linear_p95(t(spark, sf, "events"), ["event_type"], "value").withColumn("p95", F.round("p95", 9))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def last_n_per_tenant(spark, sf):
    return dedup.last_rows(t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_searches(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


_KIND = "CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'duplicate' ELSE 'processed' END"


def _outcomes(spark, sf):
    k = F.col("event_id") % 10
    kind = F.when(k == 0, "failed").when(k == 1, "quarantined").when(k == 2, "duplicate").otherwise("processed")
    return t(spark, sf, "events").select((F.col("user_id") % 5).alias("batch_id"), kind.alias("kind"), F.col("event_type").alias("reason"), (F.col("value") / 1000).alias("seconds"))


@query(
    f"""
WITH o AS (SELECT user_id % 5 AS batch_id, {_KIND} AS kind, value / 1000 AS seconds FROM events),
g AS (SELECT batch_id, count(*) FILTER (kind = 'processed') AS processed, count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind = 'quarantined') AS quarantined,
      count(*) FILTER (kind = 'duplicate') AS duplicates, count(*) AS docs_total FROM o GROUP BY 1)
SELECT batch_id, processed, failed, quarantined, duplicates, docs_total, failed + quarantined AS error_count, round(processed / (processed + failed + quarantined), 6) AS success_rate, round(duplicates / (duplicates + processed), 6) AS dedup_ratio FROM g
"""
)
def batch_summary(spark, sf):
    b = metrics.batch_metrics(_outcomes(spark, sf))
    return b.select("batch_id", "processed", "failed", "quarantined", "duplicates", "docs_total", "error_count", F.round("success_rate", 6).alias("success_rate"), F.round("dedup_ratio", 6).alias("dedup_ratio"))


@query(f"SELECT user_id % 5 AS batch_id, CASE {_KIND} WHEN 'quarantined' THEN 'quarantined_' || event_type WHEN 'duplicate' THEN 'duplicate_' || event_type ELSE event_type END AS bucket, count(*) AS n FROM events WHERE {_KIND} <> 'processed' GROUP BY ALL")
def error_buckets(spark, sf):
    return metrics.error_buckets(_outcomes(spark, sf))


@query(
    f"""WITH {_SCORES_SQL}, m AS (SELECT user_id, {_hit(5)} AS h, {_MRR} AS m, {_NDCG} AS n FROM s)
SELECT user_id, h >= 0.65 AS hit_at_5_met, m >= 0.55 AS mrr_at_10_met, n >= 0.60 AS ndcg_at_10_met, h >= 0.65 AND m >= 0.55 AND n >= 0.60 AS overall_pass FROM m"""
)
def quality_assess(spark, sf):
    q = metrics.assess(metrics.quality(_scores(spark, sf), ["user_id"]))
    return q.select("user_id", "hit_at_5_met", "mrr_at_10_met", "ndcg_at_10_met", "overall_pass")


@query(
    f"""WITH {_SCORES_SQL}, m AS (SELECT user_id, {_hit(5)} AS h, {_MRR} AS m, {_NDCG} AS n FROM s),
a AS (SELECT count(*) AS queries, avg(h) AS h, avg(m) AS m, avg(n) AS n FROM m),
c AS (SELECT *, ((h >= 0.65)::INT + (m >= 0.55)::INT + (n >= 0.60)::INT) / 3.0::DOUBLE AS c FROM a)
SELECT queries, round(h, 6) AS hit_at_5, round(m, 6) AS mrr, round(n, 6) AS ndcg, round(c, 6) AS compliance, CASE WHEN c >= 0.8 THEN 'healthy' WHEN c >= 0.6 THEN 'warning' ELSE 'critical' END AS status FROM c"""
)
def quality_summary(spark, sf):
    q = metrics.quality_summary(metrics.quality(_scores(spark, sf), ["user_id"]))
    return q.select("queries", *[F.round(c, 6).alias(c) for c in ("hit_at_5", "mrr", "ndcg", "compliance")], "status")


@query(f"WITH {_PERF_SQL} UNPIVOT (SELECT user_id, CAST(total_searches AS DOUBLE) AS total_searches, CAST(failed_searches AS DOUBLE) AS failed_searches FROM perf) ON total_searches, failed_searches INTO NAME metric VALUE value")
def metrics_export(spark, sf):
    return metrics.long_format(_performance(spark, sf).select("user_id", "total_searches", "failed_searches"), ["user_id"])


@query(
    """
WITH g AS (SELECT event_type, user_id % 3 AS step, count(*) AS runs, avg(value) AS a, list_sort(list(value) FILTER (value > 0)) AS v, avg((event_id % 4 <> 0)::INT) AS s FROM events GROUP BY ALL)
SELECT event_type, step, runs, round(a, 6) AS avg_ms, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95_ms, round(s, 6) AS success_rate FROM g
"""
)
def workflow_steps(spark, sf):
    e = t(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("step"), F.col("value").alias("duration_ms"), (F.col("event_id") % 4 != 0).alias("ok"))
    s = metrics.step_metrics(e, ["event_type", "step"])
    return s.withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("success_rate", F.round("success_rate", 6))


# ---------------------------------------------------------------- the flagship: retrieval with its quality


@query(
    f"""WITH {_BM25_SQL}, top AS (SELECT * FROM bm WHERE rank <= 10),
rel AS (SELECT query_id, rank, CAST(CASE WHEN contains(lower(d.text), lower(b.text)) THEN 1.0 WHEN l.quality = 1 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS s
        FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id LEFT JOIN labels l USING (doc_id)),
s AS (SELECT query_id AS user_id, list(s ORDER BY rank) AS v FROM rel GROUP BY query_id)
SELECT user_id AS query_id, round({_hit(5)}, 6) AS hit_at_5, round({_MRR}, 6) AS mrr, round({_NDCG}, 6) AS ndcg FROM s"""
)
def search_benchmark(spark, sf):
    from ..sources.work import cut

    d, b, lab = (t(spark, sf, n) for n in ("documents", "benchmark", "labels"))
    # written once: the lists are joined to the texts, and choose them
    top = cut(_bm25(spark, sf).select("query_id", "doc_id", "rank"), spark)
    low = d.select("doc_id", F.lower("text").alias("low")).join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    rel = top.join(low, "doc_id").join(b.select(F.col("item_id").alias("query_id"), F.lower("text").alias("head")), "query_id").join(lab.select("doc_id", "quality"), "doc_id", "left")
    rel = rel.withColumn("s", F.when(F.col("low").contains(F.col("head")), 1.0).when(F.col("quality") == 1, 0.6).otherwise(0.2))
    q = metrics.quality(metrics.score_lists(rel, ["query_id"], "rank", "s"), ["query_id"])
    return q.select("query_id", *[F.round(c, 6).alias(c) for c in ("hit_at_5", "mrr", "ndcg")])


# ---------------------------------------------------------------- drafts
_CLAIM = r"(\d+(?:\.\d+)?)[ \t\n\r\f\x0B]*([a-zA-Z%$€£¥]+)?"


@query(
    f"""
WITH c AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_CLAIM}', 1)) AS v, unnest(regexp_extract_all(text, '{_CLAIM}', 2)) AS u FROM documents)
SELECT doc_id, count(*) AS claims, round(sum(CAST(v AS DOUBLE)), 3) AS total, string_agg(DISTINCT coalesce(u, ''), ',' ORDER BY coalesce(u, '')) AS units FROM c GROUP BY doc_id
"""
)
def numeric_claims(spark, sf):
    c = t(spark, sf, "documents").select("doc_id", F.explode(drafts.numeric_claims(F.col("text"))).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("claims"), F.round(F.sum("c.value"), 3).alias("total"), F.array_join(F.sort_array(F.collect_set("c.unit")), ",").alias("units"))


@query(
    f"""
WITH c AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_CLAIM}', 1)) AS v, unnest(regexp_extract_all(text, '{_CLAIM}', 2)) AS u FROM documents),
x AS (SELECT doc_id, text, CASE WHEN u = '$' AND contains(text, '$' || v) THEN '$' || v ELSE rtrim(v || ' ' || coalesce(u, '')) END AS claim FROM c)
SELECT d.doc_id, CAST(count(claim) AS INTEGER) AS claims, coalesce(count(claim) FILTER (contains(x.text, claim)) / nullif(count(claim), 0), 1.0) AS confidence FROM documents d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""
)
def claim_verification(spark, sf):
    d = t(spark, sf, "documents")
    claims = drafts.numeric_claims(F.col("text"))
    return d.select("doc_id", F.size(claims).alias("claims"), drafts.verification(claims, F.array("text")).alias("confidence"))


@query(
    rf"SELECT doc_id, 100.0::DOUBLE - CASE WHEN regexp_matches(text, '{drafts.SSN}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(text, '{drafts.CARD_LOOSE}') THEN 30 ELSE 0 END AS score FROM documents"
)
def compliance_score(spark, sf):
    return t(spark, sf, "documents").select("doc_id", drafts.compliance(F.col("text")).alias("score"))


@query(
    rf"SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'password') THEN 'potential_password_exposure' END, CASE WHEN contains(lower(text), 'credit_card') THEN 'potential_credit_card_exposure' END, CASE WHEN contains(lower(text), 'ssn') THEN 'potential_ssn_exposure' END, CASE WHEN contains(lower(text), 'api_key') THEN 'potential_api_key_exposure' END, CASE WHEN regexp_matches(text, '{drafts.CARD_OCR}') THEN 'potential_credit_card_exposure' END, CASE WHEN length(text) > 10000 THEN 'content_too_large' END) AS flags FROM documents"
)
def ocr_compliance(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(drafts.ocr_compliance(F.col("text")), ",").alias("flags"))


def _sum_hits(words: list[str], c: str = "text") -> str:
    return "(" + " + ".join(f"contains(lower({c}), '{w}')::INT" for w in words) + ")"


@query(
    "WITH n AS (SELECT conv_id, turn, " + ", ".join(f"{_sum_hits(w)} AS {s}" for s, w in drafts.STYLES.items()) + " FROM conversations), m AS (SELECT *, greatest(formal, casual, technical, urgent) AS b FROM n) "
    "SELECT conv_id, turn, CASE WHEN b = 0 THEN 'professional' WHEN formal = b THEN 'formal' WHEN casual = b THEN 'casual' WHEN technical = b THEN 'technical' ELSE 'urgent' END AS style FROM m"
)
def style_detect(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", drafts.style(F.col("text")).alias("style"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(text, '<script>', ''), 'javascript:', ''), 'data:', ''), 'vbscript:', '')[1:2000] AS prompt FROM conversations")
def sanitize_prompt(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", drafts.sanitize(F.col("text")).alias("prompt"))


@query(f"SELECT conv_id, turn, round(greatest(1, length(text) // 4) * CASE role WHEN 'assistant' THEN 0.00003 WHEN 'user' THEN 0.000002 ELSE 0 END, 9) AS cost FROM conversations")
def cost_estimate(spark, sf):
    rates = spark.createDataFrame([("assistant", 0.00003), ("user", 0.000002)], "role string, rate double")
    c = t(spark, sf, "conversations").join(F.broadcast(rates), "role", "left")
    return c.select("conv_id", "turn", F.round(drafts.cost(X.estimate_tokens(F.col("text")), F.col("rate")), 9).alias("cost"))


_COMPLETE = f"""least(1.0, 0.6 * CASE WHEN n < 10 THEN 0.3 WHEN n < 25 THEN 0.6 WHEN n < 50 THEN 0.8 ELSE 1.0 END + 0.4 * least(1.0, 0.5 + 0.1 * (regexp_matches(lower(text), 'dear|hello|hi')::INT
 + regexp_matches(lower(text), 'sincerely|regards|thank you')::INT + contains(text, chr(10) || chr(10))::INT + (length(text) - length(replace(text, '.', '')) > 1)::INT + (length(text) - length(replace(text, chr(10), '')) > 2)::INT)))"""
_CN = f"c AS (SELECT conv_id, turn, text, CASE WHEN length({_collapse('text')}) = 0 THEN 0 ELSE len(string_split({_collapse('text')}, ' ')) END AS n FROM conversations)"
_TONE = (
    "CASE WHEN p + k + f = 0 THEN 0.7 WHEN p > 0 THEN 0.9 WHEN f > 0 THEN 0.8 ELSE 0.6 END * CASE WHEN k > p + f THEN 0.8 ELSE 1 END"
)
_TN = f"tn AS (SELECT conv_id, turn, {_sum_hits(drafts.TONES['professional'])} AS p, {_sum_hits(drafts.TONES['casual'])} AS k, {_sum_hits(drafts.TONES['formal'])} AS f FROM conversations)"
_POL_KINDS = "(" + " + ".join(f"regexp_matches(text, '{p}')::INT" for p in drafts.POLICY.values()) + ")"
_POLICY = "CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END * CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'secret') THEN 0.8 ELSE 1 END * CASE WHEN contains(lower(text), 'internal') AND contains(lower(text), 'confidential') THEN 0.9 ELSE 1 END"


@query(f"WITH {_CN} SELECT conv_id, turn, CAST(round(CASE WHEN length(text) = 0 THEN 0 ELSE {_COMPLETE} END, 6) AS DOUBLE) AS completeness FROM c")
def eval_completeness(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.round(drafts.completeness(F.col("text")), 6).alias("completeness"))


@query(f"WITH {_TN} SELECT conv_id, turn, CAST(round({_TONE}, 6) AS DOUBLE) AS tone FROM tn")
def eval_tone(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.round(drafts.tone(F.col("text")), 6).alias("tone"))


@query(f"SELECT doc_id, CAST(round({_POLICY}, 6) AS DOUBLE) AS policy FROM (SELECT doc_id, text, {_POL_KINDS} AS k FROM documents)")
def eval_policy(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(drafts.policy(F.col("text")), 6).alias("policy"))


@query(
    f"""WITH {_CN}, {_TN}, pl AS (SELECT conv_id, turn, text, {_POL_KINDS} AS k FROM conversations),
a AS (SELECT c.conv_id, c.turn, CAST({_COMPLETE} AS DOUBLE) AS cs, n FROM c),
b AS (SELECT conv_id, turn, CAST({_TONE} AS DOUBLE) AS ts FROM tn),
d AS (SELECT conv_id, turn, CAST({_POLICY} AS DOUBLE) AS ps FROM pl),
g AS (SELECT *, CASE WHEN turn = 0 THEN 0.0 ELSE 0.6 * least(turn, 4) / 4 + 0.4 END AS gs FROM a JOIN b USING (conv_id, turn) JOIN d USING (conv_id, turn)),
o AS (SELECT *, 0.4 * gs + 0.3 * cs + 0.2 * ts + 0.1 * ps AS os FROM g)
SELECT conv_id, turn, CAST(round(os, 6) AS DOUBLE) AS overall, round(gs, 9) >= 0.70 AND round(cs, 9) >= 0.65 AND round(ts, 9) >= 0.8 AND round(ps, 9) >= 0.9 AND round(os, 9) >= 0.7 AS passed FROM o"""
)
def eval_gate(spark, sf):
    used = F.least(F.col("turn"), F.lit(4))
    e = drafts.evaluate(t(spark, sf, "conversations"), "text", F.round(drafts.grounding(used, F.lit(4), used), 9))
    return e.select("conv_id", "turn", F.round("overall", 6).alias("overall"), "passed")


# ---------------------------------------------------------------- jobs, guards, relational checks
_JOBS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, user_id % 4 AS priority, event_id % 5 AS retry_count, 3 AS max_retries, ts AS created_at FROM events"


def _jobs(spark, sf):
    k = F.col("event_id") % 3
    s = F.when(k == 0, "pending").when(k == 1, "failed").otherwise("completed")
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), s.alias("status"), (F.col("user_id") % 4).alias("priority"), (F.col("event_id") % 5).alias("retry_count"), F.lit(3).alias("max_retries"), F.col("ts").alias("created_at"))


@query(f"SELECT id, priority, created_at FROM ({_JOBS}) WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 64")
def pending_jobs_topk(spark, sf):
    return search.pending_jobs(_jobs(spark, sf), 64).select("id", "priority", "created_at")


@query(f"SELECT id, CASE WHEN status = 'failed' AND retry_count < max_retries THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS retry_count FROM ({_JOBS})")
def retry_jobs(spark, sf):
    return search.retry_failed(_jobs(spark, sf)).select("id", "status", "retry_count")


@query("WITH s AS (SELECT event_id, date_trunc('day', ts) AS day, round(sum(value) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events) SELECT event_id, day, spent, spent <= 100 AS allowed FROM s")
def daily_cost_guard(spark, sf):
    from ..streaming.guards import running_budget

    b = running_budget(t(spark, sf, "events"), "day", "value", 100).withColumn("spent", F.round("spent", 6))
    return b.select("event_id", F.col("bucket").alias("day"), "spent", (F.col("spent") <= 100).alias("allowed"))


@query("WITH s AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, event_id, s <= 150 AS allowed FROM s")
def hourly_token_guard(spark, sf):
    from ..streaming.guards import running_budget

    return running_budget(t(spark, sf, "events"), "hour", "value", 150, ["user_id"]).select("user_id", "event_id", "allowed")


@query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS BIGINT) AS batch FROM events")
def microbatch_ids(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select("user_id", "event_id", F.floor((F.row_number().over(w) - 1) / 64).alias("batch"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS attempts FROM events")
def sliding_rate_60s(spark, sf):
    from ..streaming.guards import attempts_in

    return attempts_in(t(spark, sf, "events"), "user_id", 60).select("user_id", "event_id", "attempts")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    from ..streaming import guards

    return guards.replay(spark, sf, lambda e: e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s")), "complete").select(
        F.col("window.start").alias("hour"), "event_type", "n", F.round("s", 6).alias("total")
    )


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    from ..streaming import guards

    return guards.replay(spark, sf, lambda e: guards.distinct_stream(e, ["user_id", "event_type"], "ts", "30 days").select("user_id", "event_type"), "append")


@query(
    """
WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k
"""
)
def stream_session(spark, sf):
    from ..streaming import guards

    return guards.replay(spark, sf, lambda e: e.withWatermark("ts", "1 day").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")), "complete").select("user_id", F.col("session_window.start").alias("started"), "n")


@query("SELECT c_mktsegment, n_name, count(*) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def denormalize_join(spark, sf):
    o, c, n = t(spark, sf, "orders"), t(spark, sf, "customer"), t(spark, sf, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l.doc_id, quality, toxic, length(text) AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1 AND l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def label_bridge(spark, sf):
    lab, d = t(spark, sf, "labels").where("quality = 1"), t(spark, sf, "documents")
    return lab.join(d.where("lang = 'en'").select("doc_id", F.length("text").cast("long").alias("chars")), "doc_id").select("doc_id", "quality", "toxic", "chars")


@query("SELECT user_id AS tenant_id, count(*) AS doc_count, CAST(sum(strlen(props)) AS BIGINT) AS size_bytes FROM events GROUP BY 1")
def index_health(spark, sf):
    return search.index_health(t(spark, sf, "events").withColumnRenamed("user_id", "tenant_id"), "props")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def index_upsert(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "value")
    return search.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")
