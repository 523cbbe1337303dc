import datetime

from pyspark.sql import functions as F

from tidemill.operators import audit, jobs
from tidemill.sources import checkpoints

NOW = datetime.datetime(2024, 1, 10)


def test_jobs_flow(spark):
    chunks = spark.createDataFrame([("t", f"c{k}", "e", f"text {k}") for k in range(130)], "tenant_id string, chunk_id string, email_id string, content string")
    none = spark.createDataFrame([("c0",)], "chunk_id string")
    new = jobs.enqueue(chunks, none, F.lit(NOW))
    assert new.count() == 129 and jobs.check_status(new).count() == 0
    assert jobs.batch_numbers(new, ["tenant_id"]).agg(F.max("batch")).first()[0] == 2
    done = jobs.embed(new)
    rows = done.collect()
    assert {r.status for r in rows} == {"completed"} and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5

    def picky(text):
        if text == "text 5":
            raise ValueError
        return jobs.hashed_vector(text, 4)

    bad = jobs.embed(new, "picky", {"picky": picky}).where("status = 'failed'").collect()
    assert [(r.chunk_id, r.retry_count) for r in bad] == [("c5", 1)]
    store = spark.createDataFrame([("c1", [0.0], datetime.datetime(2020, 1, 1)), ("z", [1.0], NOW)], "chunk_id string, embedding array<float>, created_at timestamp")
    up = {r.chunk_id: len(r.embedding) for r in jobs.upsert_vectors(store, done).collect()}
    assert len(up) == 130 and up["c1"] == 64 and up["z"] == 1


def test_guards(spark):
    r = spark.range(1).select(
        *[jobs.cost_allowed(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in ((50, 100, 25), (50, 100, 60), (0, 100, 100))],
        *[jobs.batch_ready(F.lit(n), F.lit(s), 2, 0.1) for n, s in ((2, 0.0), (1, 0.2), (1, 0.0), (0, 9.0))],
    )
    assert list(r.first()) == [True, False, True, True, True, False, False]


def test_audit(spark):
    steps = spark.createDataFrame([("w", k, f"s{k}", float(k * 10), "failed" if k == 2 else "completed") for k in range(4)], "workflow_id string, position int, step string, duration_ms double, status string")
    cites = spark.createDataFrame([("w", "a"), ("w", "b")], "workflow_id string, chunk_uid string")
    t = audit.export_trace(steps, audit.mark_used(cites, cites.limit(1))).first()
    assert (t.steps, t.total_ms, t.p95_ms, t.failures, t.retrieval_hit_k) == (4, 60.0, 30.0, 1, 0.5)
    assert [r.event for r in audit.step_events(steps).orderBy("position").limit(2).collect()] == ["start", "complete"]


def test_checkpoints(spark):
    manifest = spark.createDataFrame([("b", f"f{k}") for k in range(3)], "batch_id string, path string")
    done = spark.createDataFrame([("b", "f0", "processed"), ("b", "f1", "failed")], "batch_id string, path string, kind string")
    assert [r.path for r in checkpoints.remaining(manifest, done).collect()] == ["f2"]
    c = checkpoints.progress_of(done, manifest.groupBy("batch_id").agg(F.count("*").alias("total_emails")), F.lit(NOW))
    r = c.first()
    assert (r.processed_emails, r.failed_emails, r.last_processed_email, r.is_complete) == (1, 1, "f1", False)
    assert checkpoints.cleanup(c, F.lit(datetime.datetime(2024, 3, 1)).cast("timestamp")).count() == 1
    assert checkpoints.recent(c, 5).count() == 1
