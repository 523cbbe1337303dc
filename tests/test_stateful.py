"""Retries, batches and resumed streams: literal cases, brute force, restarts, late rows."""

import datetime
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources.work import folder
from tidemill.streaming import batcher, resume, retries

START = datetime.datetime(2024, 1, 1)


def moment(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_delays_double_up_to_the_longest(spark):
    got = spark.range(1, 10).select(retries.delay_seconds(F.col("id")).alias("s")).collect()
    assert [r.s for r in got] == [1, 2, 4, 8, 16, 32, 60, 60, 60]


def test_third_failure_goes_to_quarantine(spark):
    tasks = spark.createDataFrame([(1, START, 0), (2, START, 1), (3, START, 9), (4, START, None)], "id long, ts timestamp, failures int")
    got = retries.retry_rounds(tasks, "id", "ts", lambda n: n > F.col("failures"))
    on, gone = retries.quarantine(got)
    assert sorted((r.id, r.attempt, r.at) for r in gone.collect()) == [(3, 3, moment(3)), (4, 3, moment(3))]
    assert sorted((r.id, r.attempt, r.status) for r in on.collect()) == [(1, 1, "completed"), (2, 1, "retry"), (2, 2, "completed"), (3, 1, "retry"), (3, 2, "retry"), (4, 1, "retry"), (4, 2, "retry")]
    assert retries.open_tasks(got, "id").count() == 0
    waiting = retries.open_tasks(got.where("id = 3 and attempt < 3"), "id").collect()
    assert [(r.id, r.failures, r.due) for r in waiting] == [(3, 2, moment(3))]


def test_queue_runs_in_waves(spark):
    tasks = spark.createDataFrame([(i, moment(100 - i), i % 4) for i in range(10)], "id long, ts timestamp, failures int")
    got = {r.id: r for r in retries.run_queue(tasks, "id", "ts", lambda n: n > F.col("failures"), slots=4).collect()}
    assert [got[i].wave for i in range(9, -1, -1)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [got[i].status for i in range(4)] == ["completed", "completed", "completed", "quarantined"]


def write(spark, at, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def test_stream_goes_on_where_it_stopped(spark):
    """Stopped after one of two files, then a third: each row once, also that of the file whose commit was lost."""
    name = f"test-{uuid.uuid4().hex}"
    at = f"{folder(spark)}/{name}-in"
    for k in (1, 2):
        write(spark, at, [(k,)], "x long")
    stream = lambda: spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(at)

    def die(epoch):
        if epoch == 1:
            raise RuntimeError("gone")

    with pytest.raises(Exception, match="gone"):
        resume.advance(name, stream(), after_write=die)
    assert resume.committed(spark, name) == [0]
    assert resume.written(spark, name, stream().schema).count() == 1
    write(spark, at, [(3,)], "x long")
    resume.advance(name, stream())
    assert sorted(r.x for r in resume.written(spark, name, stream().schema).collect()) == [1, 2, 3]
    resume.advance(name, stream())  # nothing new
    assert resume.written(spark, name, stream().schema).count() == 3
    resume.forget(spark, name)
    assert resume.committed(spark, name) == [] and resume.written(spark, name, stream().schema).count() == 0


def test_retry_state_survives_a_restart(spark):
    name = f"test-{uuid.uuid4().hex}"
    at, schema = f"{folder(spark)}/{name}-in", "id long, ts timestamp, failures long"

    def work(task, n):
        if n <= task["failures"]:
            raise ValueError

    def run():
        stream = retries.retry_stream(spark.readStream.schema(schema).parquet(at), "id", "ts", work, ["failures"], "1 second", parts=2)
        resume.advance(name, stream)
        return sorted(tuple(r) for r in resume.written(spark, name, stream.schema).collect())

    write(spark, at, [(1, START, 1), (2, START, 5)], schema)
    assert [r[:4] for r in run()] == [(1, 1, START, "retry"), (2, 1, START, "retry")]
    write(spark, at, [(3, moment(60), 0)], schema)  # the watermark passes what waits
    assert [r[:4] for r in run()] == [
        (1, 1, START, "retry"), (1, 2, moment(1), "completed"), (2, 1, START, "retry"), (2, 2, moment(1), "retry"), (2, 3, moment(3), "quarantined"), (3, 1, moment(60), "completed"),
    ]


def brute(times, size, wait):
    """Job by job."""
    out, n, first, last, closed, b = [], 0, None, None, times[0] if times else None, 0
    for i, t in enumerate(times):
        if n and last + wait < t:
            out.append((b, n, first, i - 1, last + wait, "timer"))
            b, n, closed = b + 1, 0, last + wait
        if not n:
            first = i
        n, last = n + 1, t
        if n >= size or t - closed >= wait:
            out.append((b, n, first, i, t, "count" if n >= size else "time"))
            b, n, closed = b + 1, 0, t
    if n:
        out.append((b, n, first, len(times) - 1, last + wait, "timer"))
    return out


def test_batches_close_by_count_time_or_timer():
    r = random.Random(5)
    for _ in range(400):
        times = sorted(r.randint(0, r.choice([20, 200])) for _ in range(r.randint(0, 40)))
        size, wait = r.randint(1, 6), r.randint(1, 12)
        b = batcher.Batcher(size, wait)
        got, cut = [], r.randint(0, len(times))
        ids, at = np.arange(len(times)), np.array(times, np.int64)
        got += b.jobs(ids[:cut], at[:cut])
        b = batcher.Batcher(size, wait, b.state())  # as after a restart
        got += b.jobs(ids[cut:], at[cut:]) + b.timer(10**9)
        assert got == brute(times, size, wait)


def test_ready_after_two_jobs_or_a_wait(spark):
    jobs = spark.createDataFrame([("a", 1, moment(0)), ("a", 2, moment(0.01)), ("b", 1, moment(0)), ("b", 2, moment(0.1)), (None, 7, moment(0)), ("c", 1, moment(0)), ("c", 2, moment(9))], "k string, id long, ts timestamp")
    got = sorted((tuple(r)[:5] + (r.closed_by,) for r in batcher.batches(jobs, "k", "ts", "id", 2, 0.1).collect()), key=str)
    assert got == [("a", 0, 2, 1, 2, "count"), ("b", 0, 2, 1, 2, "count"), ("c", 0, 1, 1, 1, "timer"), ("c", 1, 1, 2, 2, "time"), (None, 0, 1, 7, 7, "timer")]
    assert batcher.batches(jobs.limit(0), "k", "ts", "id").count() == 0


def test_stream_takes_late_jobs_in_order(spark):
    name = f"test-{uuid.uuid4().hex}"
    at, schema = f"{folder(spark)}/{name}-in", "k string, id long, ts timestamp"
    jobs = [("a", i, moment(3 * i)) for i in range(12)]

    def run():
        stream = batcher.batch_stream(spark.readStream.schema(schema).parquet(at), "k", "ts", "id", 4, 100, "60 seconds")
        resume.advance(name, stream)
        return sorted(tuple(r)[1:5] for r in resume.written(spark, name, stream.schema).collect())

    write(spark, at, jobs[1::2], schema)
    assert run() == []
    write(spark, at, jobs[::2] + [("a", 99, moment(1000))], schema)
    assert run() == [(0, 4, 0, 3), (1, 4, 4, 7), (2, 4, 8, 11)]
