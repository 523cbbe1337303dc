"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import render

    return render(_table(spark, sf_dir, "conversations"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import tokenized

    return tokenized(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict, training_rows

    docs = _table(spark, sf_dir, "documents")
    net = fit(training_rows(docs))
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("matches")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score, training_labels

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(_table(spark, sf_dir, "labels")))
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    return aligned(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_verbatim_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_binary": op4_token_binary,
    "op5_language_id": op5_language_id,
    "op6_fingerprint": op6_fingerprint,
    "op7_personal_data": op7_personal_data,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_verbatim_repeats": op13_verbatim_repeats,
}

_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
windows AS (
  SELECT item_id, len(w) AS m, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, 10 AS m, array_to_string(list_slice(w, k, k + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM b WHERE len(w) >= 10)),
places AS (
  SELECT doc_id, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k
        FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT p.doc_id, p.m, p.k, x.item_id FROM places p JOIN windows x USING (m, s)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
from .chat import ORACLE as _CHAT  # noqa: E402

ORACLE_SQL["op2_chat_format"] = _CHAT

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op9_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN n USING (doc_id)
"""

from . import licenses as _licenses  # noqa: E402


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in _licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', {quoted(sorted(set(text.split())))})" for label, text in _licenses.TEMPLATES)
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
p(ph, label) AS (VALUES {phrases}),
t(label, tw) AS (VALUES {templates}),
places AS (SELECT doc_id, label, k - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), p WHERE w[k] = ph[1] AND list_slice(w, k, k + len(ph) - 1) = ph),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
words AS (SELECT doc_id, label, len(tw) AS n, k, CASE WHEN list_contains(tw, w[k]) THEN w[k] END AS word
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), t),
blocks AS (SELECT doc_id, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, label ORDER BY k RANGE BETWEEN CURRENT ROW AND {_licenses.WINDOW - 1} FOLLOWING) AS c FROM words),
hits AS (SELECT doc_id, label, c / n AS containment FROM blocks WHERE c >= ceil({_licenses.THRESHOLD} * n - 1e-9)),
best AS (SELECT doc_id, max(containment) AS best FROM hits GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE_SQL["op8_license_scan"] = _license_sql()


ORACLE_SQL["op12_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, list_slice(w, k, k + size - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, g, max(f) AS up
  FROM (SELECT lang, f, list_slice(g, k, k + short - 1) AS g
        FROM (SELECT lang, f, g, short, unnest(range(1, size - short + 2)) AS k FROM f, (SELECT unnest(range(2, 5)) AS short) WHERE size > short))
  GROUP BY lang, g),
own AS (SELECT f.lang, f.g, f.size, f.f FROM f LEFT JOIN longer USING (lang, g) WHERE f.size > 1 AND (up IS NULL OR 100 * up < 100 * f.f)),
cuts AS (
  SELECT o.lang, o.g, o.f AS a, k, x.f AS l, y.f AS r, totals.n,
         CAST((CAST(1000 AS HUGEINT) * o.f * totals.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM own) o
  JOIN f x ON x.lang = o.lang AND x.g = list_slice(o.g, 1, k)
  JOIN f y ON y.lang = o.lang AND y.g = list_slice(o.g, k + 1, o.size)
  JOIN totals ON totals.lang = o.lang),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= 2000
"""

# byte b of a text is hexadecimal digits 2b + 1 and 2b + 2
ORACLE_SQL["op13_verbatim_repeats"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS i, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT i, b, substr(x, 2000 * b + 1, 2398) AS y FROM (SELECT i, x, unnest(range(0, len(x) // 2000 + 1)) AS b FROM d)),
starts AS (SELECT i, 1000 * b + q AS p, md5(substr(y, 2 * q + 1, 400)) AS s FROM (SELECT i, b, y, unnest(range(0, least(1000, len(y) // 2 - 199))) AS q FROM blocks)),
again AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY s) AS c FROM starts) WHERE c > 1),
marked AS (SELECT i, p, CASE WHEN p - lag(p) OVER (PARTITION BY i ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT i, p, sum(new) OVER (PARTITION BY i ORDER BY p) AS k FROM marked),
spans AS (SELECT i, k, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY i, k),
gaps AS (
  SELECT i, a, b, lag(b, 1, 0) OVER (PARTITION BY i ORDER BY a) AS before FROM spans),
sums AS (
  SELECT d.i, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
  FROM gaps JOIN d USING (i) GROUP BY d.i)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (i)
"""
