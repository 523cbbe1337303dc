"""Every registered query against its SQL in DuckDB, and literal cases of the operators."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemill.functions import numbers as N
from tidemill.functions import text as X
from tidemill.operators import attachments, chunking, dedup, drafts, fusion, hybrid, metrics, normalize, search, threading
from tidemill.plans import catalog, more, retrieval, stateful  # noqa: F401
from tidemill.sources import messages, storage
from tidemill.streaming import guards

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("NULL" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(*x):
    return F.array(*[F.lit(v) for v in x])


def test_ranking_literals(spark):
    a, b, c = lit(0.9, 0.8, 0.7, 0.6, 0.5), lit(0.3, 0.9, 0.4, 0.8, 0.6), lit(0.9, 0.8, 0.3, 0.7, 0.4)
    r = one(spark, N.hit_at(a, 1), N.hit_at(a, 3), N.hit_at(a, 5), N.reciprocal_rank(b), N.ndcg_linear(a, 5), *N.precision_recall_f1(c, 3))
    assert list(r)[:5] == [1.0, 1.0, 0.8, 0.5, 1.0] and all(abs(x - 2 / 3) < 1e-9 for x in list(r)[5:])


def test_fusion_literals(spark):
    a = spark.createDataFrame([("q", "chunk-1", 1, 0.9), ("q", "chunk-2", 2, 0.8)], "query_id string, chunk_id string, rank int, score double")
    b = spark.createDataFrame([("q", "chunk-1", 1, 0.95), ("q", "chunk-3", 2, 0.7)], a.schema)
    got = fusion.fused_top(a, b, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["chunk-1", "chunk-2", "chunk-3"] and got[0].sources == ["bm25", "vector"]
    assert abs(got[0].fused_score - 2 / 60) < 1e-9 and abs(got[1].fused_score - (1 / 61 + 1 / 120)) < 1e-9
    alone = fusion.fuse(a, b.limit(0)).collect()
    assert len(alone) == 2 and all(r.sources == ["bm25"] and r.vector_score == 0.0 for r in alone)


def test_draft_literals(spark):
    say = lambda t: [tuple(x) for x in one(spark, drafts.numeric_claims(F.lit(t)))[0]]
    assert say("The project costs 5000 USD and will take 3 months to complete") == [("5000 USD", 5000.0, "USD"), ("3 months", 3.0, "months")]
    assert say("No numeric values here") == [] and say("The price is 99.99 dollars")[0][1] == 99.99
    assert [x[0] for x in say("Cost: $150 and €200")] == ["150 and", "200"]
    r = one(spark, *[drafts.compliance(F.lit(t)) for t in ("fine", "ssn 123-45-6789", "ssn 123-45-6789 card 4111 1111 1111 1111")])
    assert list(r) == [100.0, 70.0, 40.0]


def test_query_validation(spark):
    for q, ok, n in (("", False, 1), ("   ", False, 1), ("*", False, 1), (".*", False, 1), ("x <script> y", False, 1), ("one", True, 1), ("the and", True, 1), ("two words", True, 0), ("a b " * 200, True, 1)):
        good, warn = search.validate_query(F.lit(q))
        assert tuple(one(spark, good, F.size(warn))) == (ok, n), q


def test_text_literals(spark):
    r = one(spark, X.normalize_subject(F.lit("Re: Re:  Hello,  World!")), X.normalize_subject(F.lit("")), X.strip_signature_and_quotes(F.lit("a\n\nb\nBest regards,\nJo\n> q")), X.estimate_tokens(F.lit("")))
    assert list(r) == ["re hello world", "no_subject", "a\n\nb", 1]
    assert one(spark, X.address_list(F.lit("A B <a@x.org>, ,c@y.org")))[0] == ["a@x.org", "c@y.org"]
    assert one(spark, chunking.sentences(F.lit("Hi! Ok? yes")))[0] == ["Hi.", "Ok.", "yes."]


def test_chunks_against_a_plain_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.c for r in docs.select("doc_id", chunking.chunk_texts(F.col("text"), 300, 50).alias("c"), "text").collect()}
    for r in docs.select("doc_id", chunking.sentences(F.col("text")).alias("s")).collect():
        out, cur = [], ""
        for s in r.s:
            if cur and len(cur) + len(s) > 300:
                out.append(cur)
                cur = cur[-50:] + s
            else:
                cur += s
        assert got[r.doc_id] == out + ([cur] if cur else [])


def test_near_resolution_is_greedy(spark):
    import random

    rnd = random.Random(4)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(70)})
    got = {r.node: (r.leader, r.original) for r in dedup.resolve_near(spark.createDataFrame(edges, "a long, b long"), spark.range(40).withColumnRenamed("id", "node")).collect()}
    leaders = []
    for n in range(40):
        first = next((x for x in leaders if (x, n) in edges), None)
        assert got[n] == (first is None, first)
        leaders += [n] if first is None else []


def test_near_resolution_of_a_long_chain(spark):
    got = dedup.resolve_near(spark.createDataFrame([(k, k + 1) for k in range(70)], "a long, b long"), spark.range(71).withColumnRenamed("id", "node")).collect()
    assert {(r.node, r.leader, r.original) for r in got} == {(k, k % 2 == 0, None if k % 2 == 0 else k - 1) for k in range(71)}


def test_values_at_ranks(spark):
    import statistics

    from tidemill.operators import ranks

    data = {"a": [float(x * 7 % 113) for x in range(400)], "b": [3.0] * 150, None: [1.0, 2.0], "d": [float(x) for x in range(100)]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("empty", None)], "g string, v double")
    got = {r.g: r for r in ranks.values_at(df, ["g"], "v", {"p95": ranks.nearest(0.95), "q95": ranks.exclusive(20, 19), "q99": ranks.exclusive(100, 99)}).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g].n == len(vs) and got[g].p95 == sorted(vs)[int(len(vs) * 0.95)]
        for name, parts in (("q95", 20), ("q99", 100)):
            want = statistics.quantiles(vs, n=parts)[-1] if len(vs) >= parts else None
            assert (got[g][name] is None) == (want is None) and (want is None or abs(got[g][name] - want) < 1e-9)


def test_hybrid_literals(spark):
    schema = "query_id long, chunk_id long, rank int, score double"
    a = spark.createDataFrame([(1, 7, 1, 9.0), (1, 8, 2, 8.0), (2, 9, 1, 5.0)], schema)
    b = spark.createDataFrame([(1, 8, 1, 0.9), (3, 5, 1, 0.8)], schema)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score, r.sources) for r in hybrid.hybrid_search(a, b, 2).collect()}
    assert got[1, 1][0] == 8 and got[1, 1][2] == ["bm25", "vector"] and abs(got[1, 1][1] - (1 / 61 + 1 / 60)) < 1e-9
    assert got[2, 1] == (9, 5.0, ["bm25"]) and got[3, 1] == (5, 0.8, ["vector"])
    assert hybrid.hybrid_search(a.limit(0), b.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        hybrid.retrieve(None, None)
    r = spark.createDataFrame([(1, "t", "  " + "q" * 600, 50), (2, "t", " ", 5), (3, None, "x", 5), (4, "u", "x", None)], "query_id long, tenant_id string, query string, k int")
    kept = {x.query_id: (len(x.query), x.k) for x in hybrid.guard_requests(r).collect()}
    assert kept == {1: (500, 20), 4: (1, 20)}
    hits = spark.createDataFrame([(1, "t"), (1, "u"), (4, "u")], "query_id long, tenant_id string")
    assert {tuple(x) for x in hybrid.own_citations(hits, r).collect()} == {(1, "t"), (4, "u")}


def test_fields_and_fuzzy_terms(spark):
    d = spark.createDataFrame([(1, "alpha report", "nothing here", 1), (2, "other", "alpha alpha beta", 2), (3, "other", "alphq beta", 3)], "id long, subject string, body string, sent long")
    q = spark.createDataFrame([(1, "alpha")], "q long, text string")
    top = lambda **o: [(r.id, r.field) for r in hybrid.bm25_fields(d, q, "id", {"subject": "subject", "content": "body"}, "q", "text", newest="sent", **o).orderBy("rank").collect()]
    assert top() == [(1, "subject"), (2, "content")]
    assert top(fuzzy=True) == [(1, "subject"), (3, "content"), (2, "content")] or {x[0] for x in top(fuzzy=True)} == {1, 2, 3}


def test_normalization(spark):
    d = spark.createDataFrame([(1, "Hello  there\n\nmore\n-- \nJo"), (2, "<p>Hi <b>you</b></p>"), (3, "")], "id long, text string")
    kind = F.when(F.col("id") == 2, "text/html").otherwise("text/plain")
    got = {r.id: r for r in normalize.normalize_content(d, "text", kind).collect()}
    assert got[1].normalized_text.startswith("Hello there\n\nmore") and got[2].manifest.normalization_steps[0] == "html_to_text"
    assert got[3].manifest.length_chars == 0 and got[3].manifest.token_estimate == 1 and got[1].manifest.stripped_blocks == 0


def test_threads(spark):
    m = [("t", 0, "a", "Hello", None, []), ("t", 1, "b", "Re: Hello", "a", ["a"]), ("t", 2, "c", "Other", None, ["zz", "b"]), ("t", 3, "d", "hello", None, []), ("u", 0, "e", "Hello", None, [])]
    df = spark.createDataFrame(m, "tenant_id string, seq long, message_id string, subject string, in_reply_to string, refs array<string>")
    assert {r.message_id: r.thread_root for r in threading.assign(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <a@x>\nSubject: S\nFrom: N <n@x.org>\nTo: A <a@y.org>, b@y.org\nDate: Mon, 15 Jan 2024 10:00:00 +0000\n\nBody text\n")
    (tmp_path / "b.eml").write_bytes(
        b'Subject: M\nFrom: n@x.org\nIn-Reply-To: <a@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/html\n\n<p>Hi</p>\n--B\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="q.pdf"\n\nPDF\n--B--\n'
    )
    (tmp_path / "c.txt").write_text("no mail")
    got = {r.path[-5:]: r for r in messages.parse_messages(messages.scan_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.eml", "b.eml"}
    assert got["a.eml"].to_addresses == ["a@y.org", "b@y.org"] and got["a.eml"].body.strip() == "Body text" and got["a.eml"].date == datetime.datetime(2024, 1, 15, 10)
    assert got["b.eml"].attachments[0].filename == "q.pdf" and got["b.eml"].in_reply_to == "<a@x>" and got["b.eml"].date is None
    (tmp_path / "m.json").write_text('{"batch_id": "b1", "file_manifest": [{"file_path": "x/a.eml", "file_name": "a.eml", "file_size": 3}]}')
    assert [r.file_name for r in messages.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a.eml"]


def test_storage_paths(spark):
    ok = lambda p: one(spark, storage.is_valid_path(F.lit(p)))[0]
    assert ok("tenant-123/2024/01/15/file.txt") and ok("dev-123/2024/01/15/f") and not ok("") and not ok("invalid/path") and not ok("tenant-1/2024/01/15/../x")
    assert one(spark, storage.safe_name(F.lit("file/with\\dangerous:chars*.pdf")))[0] == "file_with_dangerous_chars_.pdf"
    p = one(spark, storage.parse_path(F.lit("tenant-123/2024/01/15/thread-456/email-789/raw/message.eml")))[0]
    assert (p.tenant, p.date, p.thread, p.email, p.kind, p.filename) == ("tenant-123", "2024/01/15", "thread-456", "email-789", "raw", "message.eml")


def test_batch_metrics(spark):
    o = [("b", "processed", None, x) for x in (0.5, 0.3, 0.7)] + [("b", "failed", "MALFORMED_MIME", 0.1), ("b", "failed", "OVERSIZED_EMAIL", 0.1)]
    o += [("c", "processed", None, 1.0)] * 2 + [("c", "duplicate", "exact", 0.0)] * 2
    df = spark.createDataFrame(o, "batch_id string, kind string, reason string, seconds double")
    got = {r.batch_id: r for r in metrics.batch_metrics(df).collect()}
    assert got["b"].docs_total == 5 and got["b"].error_count == 2 and got["c"].dedup_ratio == 0.5
    assert {(r.bucket, r.n) for r in metrics.error_buckets(df).where("batch_id = 'b'").collect()} == {("MALFORMED_MIME", 1), ("OVERSIZED_EMAIL", 1)}


def test_patches(spark):
    df = spark.createDataFrame([("w", 1, "a", None), ("w", 2, None, 5), ("w", 3, "b", None)], "k string, o int, x string, y int")
    assert tuple(attachments.fold_patches(df, "k", "o", ["x", "y"]).first()) == ("w", "b", 5)
    with pytest.raises(ValueError):
        attachments.fold_patches(df, "k", "o", ["tenant_id"])


def test_rate_limit_batch_and_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    ev = [(i, t0 + datetime.timedelta(seconds=20 * i), 1, "x", 1.0, "{}") for i in range(12)]
    df = spark.createDataFrame(ev, guards.EVENTS)
    batch = {r.event_id: r.admitted for r in guards.admitted(df, "user_id", 2).collect()}
    assert [batch[i] for i in range(6)] == [True, True, False, True, True, False]
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    s = spark.readStream.schema(guards.EVENTS).parquet(str(tmp_path / "events.parquet"))
    q = guards.admitted_stream(s, "user_id", 2).writeStream.format("memory").queryName("adm").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.admitted for r in spark.table("adm").collect()} == batch
    with pytest.raises(ValueError):
        search.search_filters(df, None)


def test_daily_cost_covers_every_event(spark):
    got = catalog.QUERIES["daily_cost_guard"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r.allowed for r in got.select("allowed").distinct().collect()} == {True, False}


def test_running_budget_in_slices(spark):
    """One day over many slices, with ties, nulls and a null key."""
    day = datetime.datetime(2024, 1, 1)
    at = [day + datetime.timedelta(seconds=k // 3) for k in range(600)]
    events = spark.createDataFrame([(k, at[k], None if k % 7 == 0 else float(k % 5), None if k % 2 else "a") for k in range(600)], "event_id long, ts timestamp, value double, who string")
    for keys in ([], ["who"]):
        df = guards.running_budget(events.repartition(5), "day", "value", 300, keys)
        spent = {}
        for r in sorted(df.collect(), key=lambda r: (r.ts, r.event_id)):
            key = r.who if keys else 0
            if r.value is not None:
                spent[key] = spent.get(key, 0.0) + r.value
            assert r.spent == spent.get(key) and r.allowed == (None if r.spent is None else r.spent <= 300)
    assert "_slice" in guards.running_budget(events, "day", "value", 300)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_threshold_after"])
def test_vector_queries_in_blocks(spark, con, name, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.SQL[name]).df())


def test_minhash_has_128_permutations(spark):
    text = " ".join(f"word{k}" for k in range(200))
    d = spark.createDataFrame([(1, text), (2, text), (3, text + "".join(f" more{k}" for k in range(40)))], "doc_id long, text string")
    s = dedup.minhash(d, "doc_id", "text")
    assert {len(r.signature) for r in s.collect()} == {128}
    got = dedup.minhash_pairs(s, "doc_id").collect()
    assert [(r.a, r.b) for r in got] == [(1, 3)] and 0 < got[0].similarity < 1


def test_union_covers_every_event(spark):
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalog.QUERIES["union_all"](spark, SF).agg(F.sum("n")).first()[0] == total
