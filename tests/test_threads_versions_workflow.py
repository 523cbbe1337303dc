"""Threads against a fold, versioned tables, the attachment workflow."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemill.operators import threading, workflow
from tidemill.sources import versions

MAIL = "tenant_id long, seq long, message_id string, subject string, in_reply_to string, refs array<string>"


def fold(messages):
    """First hit in arrival order, one message after another."""
    by_id, by_subject, out = {}, {}, []
    for tenant, seq, mid, subject, reply, refs in sorted(messages, key=lambda m: (m[1], m[2] or f"seq-{m[1]}")):
        looks = [x for x in [mid, reply, *(refs or [])] if x]
        known = [by_id[tenant, x] for x in looks if (tenant, x) in by_id]
        topic = (tenant, subject.lower().removeprefix("re:").strip()) if subject else None
        if not known and topic in by_subject:
            known = [by_subject[topic]]
        root = known[0] if known else mid or f"seq-{seq}"
        if not known and topic:
            by_subject[topic] = root
        if mid:
            by_id.setdefault((tenant, mid), root)
        out.append((tenant, seq, mid, root))
    return sorted(out, key=str)


def test_threads_like_a_fold(spark):
    r = random.Random(4)
    name = lambda: f"m{r.randint(0, 90)}"
    for density in (0.2, 0.9):
        mail = [
            (r.choice([1, 2, None]), seq, r.choice([name(), name(), f"own{seq}", None, ""]) if r.random() < 0.3 else f"m{seq}", r.choice(["", None, "Re: a", "A", "b", f"s{seq}"]), name() if r.random() < density else r.choice([None, ""]),
             r.choice([None, [], [name()], ["", name(), name()]]) if r.random() < density else None)
            for seq in range(150)
        ]
        got = sorted((tuple(x) for x in threading.assign(spark.createDataFrame(mail, MAIL)).collect()), key=str)
        assert got == fold(mail)


def test_a_long_chain_takes_few_rounds(spark):
    """Each message answers the one before: a chain of a thousand, in one tenant."""
    n = 1000
    mail = spark.range(n).select(F.lit(1).alias("tenant_id"), F.col("id").alias("seq"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.lit("x").alias("subject"), F.when(F.col("id") > 0, F.concat(F.lit("m"), (F.col("id") - 1).cast("string"))).alias("in_reply_to"), F.lit(None).cast("array<string>").alias("refs"))
    assert [tuple(x) for x in threading.assign(mail).groupBy("thread_root").count().collect()] == [("m0", n)]


def test_thread_lookups(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, 1, "a", "Plan", None, None, day(3)), (1, 2, "b", "Re: plan", "a", None, day(2)), (1, 3, "c", "Other", None, None, day(4)), (2, 1, "d", "plan", None, None, day(5))]
    mail = spark.createDataFrame(rows, MAIL + ", date timestamp")
    assigned = threading.assign(mail)
    info = threading.thread_info(assigned, mail)
    got = {(r.tenant_id, r.thread_root): r for r in info.collect()}
    a = got[1, "a"]
    assert (a.email_count, a.first_date, a.last_date, a.depth, a.breadth, a.subject_norm) == (2, day(3), day(2), 2, 2, "plan") and got[1, "c"].depth == 1
    asked = spark.createDataFrame([(1, "RE: PLAN"), (2, "nothing")], "tenant_id long, subject string")
    assert [r.thread_root for r in threading.threads_by_subject(info, asked).collect()] == ["a"]
    asked = spark.createDataFrame([(1, "b"), (1, "d"), (2, "d")], "tenant_id long, message_id string")
    assert sorted((r.message_id, r.thread_root, r.email_count) for r in threading.thread_by_message(info, assigned, asked).collect()) == [("b", "a", 2), ("d", "d", 1)]


# ---------------------------------------------------------------- versions
def test_an_alias_names_one_whole_version(spark):
    s = versions.Store(spark, uuid.uuid4().hex)
    one, two = spark.range(3), spark.range(10, 15)
    assert s.create("t", one.schema) and not s.create("t", one.schema)
    assert s.read("t").count() == 0
    s.switch("t", s.write("t", one))
    before = s.read("t")  # a reader that resolved the alias
    n = s.write("t", two)
    assert s.read("t").count() == 3  # written, not named
    s.switch("t", n)
    assert before.count() == 3 and sorted(r.id for r in s.read("t").collect()) == [10, 11, 12, 13, 14]
    s.switch("t", 1, "old")
    assert s.retain("t", 1) == [1, n] and s.read("t", "old").count() == 3
    s.drop_alias("t", "old")
    assert s.retain("t", 1) == [n]
    with pytest.raises(LookupError):
        s.read("t", "old")
    with pytest.raises(ValueError):
        s.switch("t", 1)


def test_writers_never_share_a_version(spark):
    s = versions.Store(spark, uuid.uuid4().hex)
    s.create("t", spark.range(1).schema)
    assert s._claim("t/versions/1.claim")  # another writer is at work, or died
    assert s.write("t", spark.range(2)) == 2 and s.versions("t") == [0, 2]
    with pytest.raises(ValueError):
        s.switch("t", 1)


def test_benchmarks_newest_first(spark):
    b = versions.Benchmarks(spark, uuid.uuid4().hex)
    assert b.recent(3) is None
    for k in range(3):
        b.save(spark.range(k + 1))
    assert sorted((r.run, r.id) for r in b.recent(2).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    b.reset()
    assert b.recent(1) is None


# ---------------------------------------------------------------- workflow
def test_attachments_end_in_one_state(spark):
    long = "words of a letter that can be read well " * 3
    rows = [(1, "text/plain", 10, long, 0), (2, "text/plain", 10, "??", 0), (3, "image/png", 10, None, 2), (4, "image/png", 10, None, 9), (5, "application/zip", 10, long, 0), (6, "text/plain", None, long, 0), (7, None, 1, None, 0), (8, "application/pdf", 5, None, 0)]
    tasks = spark.createDataFrame(rows, "id long, mimetype string, size_bytes long, native_text string, failures int").withColumns({"tenant_id": F.lit("t"), "email_id": F.lit("e"), "filename": F.lit("f"), "status": F.lit("clash")})
    done = workflow.process(tasks, lambda n: F.when(n > F.col("failures"), "an ssn"))
    got = {r.id: r for r in done.collect()}
    assert {i: r.current_step for i, r in got.items()} == {1: "workflow_completed", 2: "workflow_completed", 3: "workflow_completed", 4: "workflow_failed", 5: "workflow_failed", 6: "workflow_failed", 7: "workflow_failed", 8: "workflow_completed"}
    assert {i for i, r in got.items() if r.quarantined} == {4, 5, 6, 7}
    assert [got[i].attempts for i in (1, 2, 3, 4, 8)] == [None, 1, 3, 3, 1]
    assert got[3].compliance_checks == ["potential_ssn_exposure"] and got[3].storage_key == "t/emails/e/attachments/f/text" and got[4].storage_key is None
    assert got[7].error_message == "Unsupported mimetype: none" and all(r.status == "clash" for r in got.values())
    told = {(r.success, r.quarantined) for r in workflow.outcome(done).collect()}
    assert told == {(True, False), (False, True)}
    assert workflow.process(tasks.limit(0), lambda n: F.lit("x")).count() == 0


def test_a_patch_may_not_set_other_columns(spark):
    with pytest.raises(ValueError):
        workflow.apply(spark.range(1), lambda: {"tenant_id": F.lit("x")})
