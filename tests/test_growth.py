"""What must not grow faster than the tables: broadcasts through the driver, pairs of vectors in Spark rows, shuffled words."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.functions.numbers import cosine
from tidemill.operators import attachments, dedup, nearest, normalize, search, vectors
from tidemill.plans import catalog, retrieval  # noqa: F401

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_not_broadcast_and_come_once(spark):
    """The planner takes rows for small before they are exploded into 62 keys."""
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 60, 40)]
    flips = lambda n: sum(1 << int(b) for b in r.choice(60, n, replace=False))
    all_ = sorted({x ^ flips(k) for x in base for k in range(12)} | set(base))
    h = spark.createDataFrame(list(enumerate(all_)), "doc_id long, simhash long")
    p = dedup.near_duplicate_pairs(h, "doc_id")
    text = plan(p)
    assert "ShuffledHashJoin" in text and "BroadcastHashJoin" not in text
    want = sorted((x, y, (x ^ y).bit_count()) for x in all_ for y in all_ if x < y and (x ^ y).bit_count() <= 9)
    assert sorted(map(tuple, p.collect())) == want


def test_no_word_is_shuffled_for_hashes_and_rows_of_one_id_vote_together(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma gamma"), (2, "alpha beta alpha gamma gamma"), (3, None), (4, "a")], "doc_id long, text string")
    s = {r.doc_id: r.simhash for r in dedup.simhash(d, "doc_id", "text").collect()}
    assert s[1] == s[2] != 0 and s[3] == s[4] == 0
    m = {r.doc_id: r.signature for r in dedup.minhash(d, "doc_id", "text").collect()}
    assert m[1] == m[2] and set(m) == {1, 2} and len(m[1]) == 128
    for f in (dedup.simhash, dedup.minhash):
        assert "explode" not in plan(f(spark.read.parquet(DOCS), "doc_id", "text"))


def brute(v, q, k, threshold, after=False):
    """Every pair as a row."""
    hits = v.join(F.broadcast(q)).where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score")).where("score is not null")
    if threshold is not None and not after:
        hits = hits.where(F.col("score") >= threshold)
    hits = search.top_k(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k)
    return hits.where(F.col("score") >= threshold) if after else hits


def test_nearest_vectors_with_copies_and_odd_ones(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8)).round(1)
    x[50:150] = x[7]
    x[150:180] = x[150:180] + 1e-10
    rows = [(i, [float(y) for y in z]) for i, z in enumerate(x)]
    rows += [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (902, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 7 = 0 or vec_id > 800").selectExpr("vec_id as query_id", "embedding as q")
    odd = v.union(spark.createDataFrame([(903, None), (904, []), (905, [None, 1.0]), (906, [0.0, 0.0]), (None, [1.0, 1.0])], v.schema))
    for threshold, after in ((0.1, False), (0.25, True), (None, False)):
        got = search.vector_top_k(odd, q, 5, threshold, after)
        assert "NestedLoop" not in plan(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(v, q, 5, threshold, after).collect()))
    blocks = nearest.candidates(v, q, 5, block_bytes=600)
    assert len(blocks) > 3 and sum(b.select("query_id").distinct().count() for b in blocks) == q.count()


def test_index_searches_by_block(spark):
    v, q = catalog._queries(spark, "/root/testdata/sf0.001")
    centers = vectors.fit(v, 8)
    got = vectors.search_index(vectors.index(v, centers), centers, q, k=5, probes=3)
    cell = vectors.index(v, centers).select("vec_id", "cell")
    pairs = vectors._cells(q, centers, "q", 3).select("query_id", "cell").join(cell, "cell").select("query_id", "vec_id")
    hits = pairs.join(v, "vec_id").join(q, "query_id").where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding").cast("array<float>"), F.col("q").cast("array<float>")), 9).alias("score"))
    want = search.top_k(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(got)


def test_open_references_stay_in_extracted_text():
    got = attachments.EXTRACTORS["text/html"](b"<title>a&amp;&amp</title><style>p{}</style><p>&quot;b&quot; &copy; c&am</p>&#65; & d &amp;amp; &")
    assert got == 'a&&amp "b" \u00a9 c&am A & d &amp; &'


def test_extraction_is_its_sql_on_cut_references(spark, tmp_path):
    pages = [(4, "u", "<h1>x&amp;&amp</h1><p>y&am</p>"), (8, "u", "<p>&middot; &amp;</p>"), (5, "u", "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.SQL["extract_documents"]).fetchall()
    assert sorted(map(tuple, catalog.extract_documents(spark, str(tmp_path)).collect())) == sorted(want)


def test_word_lists_are_looked_up_by_hash(spark):
    d = spark.read.parquet(DOCS)
    for c in (X.detect_language(F.col("text")), X.features(F.col("text")), search.analyze(F.col("text"))):
        got = d.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert "INSET" in got.upper() and "array_contains" not in got
    assert d.select(X.detect_language(F.col("text")).alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_bm25_reads_its_texts_once(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "the of"), (3, None), (4, "red red cat")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red"), (8, "the")], "query_id long, query string")
    top = search.bm25(d, q, "doc_id", "text", "query_id", "query")
    assert "regexp_extract_all" not in top._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert [(r.query_id, r.doc_id, r["rank"]) for r in top.orderBy("rank").collect()] == [(7, 4, 1), (7, 1, 2)]
    tf, df, stats = search.counted_terms(d.select("doc_id", search.analyze(F.coalesce("text", F.lit(""))).alias("terms")), ["doc_id"], q.select(F.lit("red").alias("term")).distinct(), [])
    assert [tuple(r) for r in stats.collect()] == [(4, 5 / 4)] and [tuple(r) for r in df.collect()] == [("red", 2)]
    for x in (tf, df, stats):
        assert "regexp_extract_all" not in plan(x)


def test_normalization_works_out_what_is_asked(spark):
    """The language is not; nor do patterns run line by line, or from every blank to the end of its run."""
    got = catalog.QUERIES["normalize_content"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in got and "INSET" not in got
    assert "transform(" not in got and "+$" not in got
    d = spark.createDataFrame([(1, "the dog and the cat\n--\nJo")], "id long, text string")
    r = normalize.normalize_content(d, "text", F.lit("text/plain")).first()
    assert (r.manifest.detected_language, r.manifest.length_chars, r.manifest.token_estimate, r.word_count, r.removed_lines) == ("en", 19, 4, 5, 2)
    run = spark.createDataFrame([(1, "a" + "\f" * 2000 + "a\f")], "id long, text string")
    assert run.select(X.strip(F.col("text"))).first()[0] == "a" + "\f" * 2000 + "a"


ODD = " |  |\t|\n|\n|\n\n|\r|\r\n|\f|\x0b|a|b c|\u00e9|\U0001f600|>|--|-- |-|Thanks,|thanks|KIND REGARDS|Get Outlook for |iOS|sent from |\u017fent from |than\u212as|s\u0131ncerely|From:|from:|To:|.|\u00a0|\x85|\u2028|\u2029|\x1c|\x00|&amp;|<p>"


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    at, r = str(tmp_path_factory.mktemp("odd")), random.Random(7)
    rows = [(i, "".join(r.choice(ODD.split("|")) for _ in range(r.randrange(15)))) for i in range(8000)] + [(8000, None)]
    rows += [(8001 + i, x) for i, x in enumerate(["x\n\u017fent from y", "x\nthan\u212as", "x\ns\u0131ncerely", "x\nGet Outlook for \t\ny", "x\ncheers\u2028", "x \u2028"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["normalize_content", "strip_signature_quote", "plain_normalize", "html_strip", "html_visible_text"])
def test_odd_line_ends_and_blanks_are_as_in_sql(spark, odd_texts, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{odd_texts}/{table}.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL[name]).fetchall(), key=lambda r: r[0])
    assert sorted(map(tuple, catalog.QUERIES[name](spark, odd_texts).collect()), key=lambda r: r[0]) == want
