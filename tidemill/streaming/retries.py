"""Retries with exponential back-off and a quarantine, over a stream and over a table.

A task that fails is tried again ``base * 2 ** (failures - 1)`` seconds later, at
most ``longest``; the failure number ``attempts`` sends it to quarantine.  Both
forms give one row per attempt: key, attempt (from 1), at, status (``completed``,
``retry`` or ``quarantined``), due (when it is tried again).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.work import cut, ship

# Attempts in all, first and longest delay in seconds.
ATTEMPTS = 3
BASE_SECONDS = 1.0
LONGEST_SECONDS = 60.0


def delay_seconds(failures: Column, base: float = BASE_SECONDS, longest: float = LONGEST_SECONDS) -> Column:
    """Seconds between failure number ``failures`` and the next attempt."""
    return F.least(F.lit(float(longest)), F.lit(float(base)) * F.pow(F.lit(2.0), failures - 1))


def retry_rounds(tasks: DataFrame, key: str, at: str, succeeds: Callable[[Column], Column], attempts: int = ATTEMPTS, base: float = BASE_SECONDS, longest: float = LONGEST_SECONDS) -> DataFrame:
    """All attempts of a table of tasks: a round for each attempt, over what is still open.

    ``succeeds`` tells from the attempt's number, and the task's columns, whether
    it succeeds; null counts as a failure.  Each round is a projection and a
    filter, so nothing is shuffled, and there are ``attempts`` rounds at most.
    """
    open_, done = tasks.withColumn("_at", F.col(at).cast("timestamp")), None
    for n in range(1, attempts + 1):
        number = F.lit(n)
        ok = F.coalesce(succeeds(number), F.lit(False))
        status = F.when(ok, "completed").otherwise("quarantined" if n == attempts else "retry")
        due = F.timestamp_micros(F.unix_micros("_at") + (delay_seconds(number, base, longest) * 1e6).cast("long"))
        tried = open_.withColumn("_status", status).withColumn("_due", F.when(F.col("_status") == "retry", due))
        rows = tried.select(key, number.alias("attempt"), F.col("_at").alias("at"), F.col("_status").alias("status"), F.col("_due").alias("due"))
        done = rows if done is None else done.unionByName(rows)
        open_ = tried.where("_status = 'retry'").withColumn("_at", F.col("_due")).drop("_status", "_due")
    return done


class Retries(StatefulProcessor):
    """The waiting tasks of one part of the keys, with one timer for the earliest of them.

    A retry runs when the watermark passes its due time, so it is the same
    whenever the rows arrive; a task's state is dropped with its last attempt.
    """

    def __init__(self, key: str, work: Callable[[dict, int], object], attempts: int, base: float, longest: float, payload: list[str]):
        self.key, self.work, self.attempts, self.base, self.longest, self.payload = key, work, attempts, base, longest, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "tasks string")

    def _run(self, waiting: list, now_us: int) -> Iterator[pd.DataFrame]:
        """First attempts, and those of [key, failures, due, payload] that are due now; what still waits goes back to the state."""
        rows, left = [], []
        for k, failures, due, task in waiting:
            while due is not None and (failures == 0 or due <= now_us):
                failures, at = failures + 1, due
                try:
                    self.work(task, failures)
                    status = "completed"
                except Exception:  # whatever the work raises is a failed attempt
                    status = "quarantined" if failures == self.attempts else "retry"
                due = at + int(min(self.longest, self.base * 2 ** (failures - 1)) * 1e6) if status == "retry" else None
                rows.append((k, failures, at, status, due))
            if due is not None:
                left.append([k, failures, due, task])
        if left:
            self.state.update((json.dumps(left),))
            self.handle.registerTimer(-(-min(x[2] for x in left) // 1000))
        else:
            self.state.clear()
        if rows:
            out = pd.DataFrame(rows, columns=[self.key, "attempt", "at", "status", "due"])
            for c in ("at", "due"):
                out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
            yield out

    def _waiting(self) -> list:
        return json.loads(self.state.get()[0]) if self.state.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        known = {x[0] for x in waiting}
        native = lambda v: v.item() if hasattr(v, "item") else v
        new = pd.concat(list(rows)).sort_values("at_us")
        for r in new.itertuples(index=False):
            k = native(getattr(r, self.key))
            if k not in known:  # a task that comes again while it waits is the same task
                known.add(k)
                waiting.append([k, 0, int(r.at_us), {c: native(getattr(r, c)) for c in self.payload}])
        yield from self._run(waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(self._waiting(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame) -> None:
    """Keyed state with timers needs the RocksDB store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retry_stream(tasks: DataFrame, key: str, at: str, work: Callable[[dict, int], object], payload: list[str], late: str = "10 minutes", attempts: int = ATTEMPTS, base: float = BASE_SECONDS, longest: float = LONGEST_SECONDS, parts: int = 64) -> DataFrame:
    """The attempts of a stream of tasks.

    ``work`` gets the task's ``payload`` columns and the attempt's number, and
    raises to fail.  The first attempt is made when a task comes, which may be
    ``late``; a retry waits until the watermark passes its due time.  State is kept
    by ``parts`` hashed parts of the keys: set it to some times the number of cores.
    """
    ship(tasks.sparkSession)
    stateful(tasks)
    kind = tasks.schema[key].dataType.simpleString()
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    marked = tasks.withWatermark(at, late).select(part, key, F.unix_micros(at).alias("at_us"), *[c for c in payload if c != key], at)
    return marked.groupBy("part").transformWithStateInPandas(
        Retries(key, work, attempts, base, longest, payload), f"{key} {kind}, attempt int, at timestamp, status string, due timestamp", "Append", "EventTime"
    )


def quarantine(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes on, and the tasks that were given up."""
    gone = F.col("status") == "quarantined"
    return attempts.where(~gone), attempts.where(gone)


def open_tasks(attempts: DataFrame, key: str) -> DataFrame:
    """Tasks whose last attempt was neither a success nor the last allowed: when they are due, and how often they failed."""
    last = attempts.groupBy(key).agg(F.max_by(F.struct("status", "due", "attempt"), "attempt").alias("x"))
    return last.where("x.status = 'retry'").select(key, F.col("x.attempt").alias("failures"), F.col("x.due").alias("due"))


def run_queue(tasks: DataFrame, key: str, at: str, succeeds: Callable[[Column], Column], slots: int | None = None, **limits) -> DataFrame:
    """The last word on each task of a queue: status, attempts and when it ended; with ``slots``, the wave it runs in.

    Waves are by order of (at, key) over all tasks: the queue starts ``slots`` of
    them together, so wave ``k`` holds the tasks from number ``k * slots`` on.
    """
    tried = retry_rounds(tasks, key, at, succeeds, **limits)
    ended = tried.where("status <> 'retry'").select(key, "status", F.col("attempt").alias("attempts"), F.col("at").alias("ended"))
    if slots is None:
        return ended
    # numbers by slices in order, so that no task sees the whole queue
    dealt = cut(tasks.select(key, at).repartitionByRange(at, key).withColumn("_slice", F.spark_partition_id()), tasks.sparkSession)
    from pyspark.sql.window import Window

    sizes = dealt.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_slice").orderBy(at, key)) - 1
    wave = dealt.withColumn("_k", number).join(F.broadcast(before), "_slice").select(key, F.floor((F.col("_k") + F.col("_before")) / slots).alias("wave"))
    return ended.join(wave, key)
