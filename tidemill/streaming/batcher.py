"""Batches that close by count or by time, over a stream and over a table.

A key's batch closes at its ``size``-th job, or at a job that comes ``seconds``
or more after the last close; a batch that then gets no job is closed by a timer
``seconds`` after its last one.  The clock starts with the first job of a key.
Both forms give one row per batch: key, batch (from 0), jobs, first_id, last_id,
closed_at, closed_by (``count``, ``time`` or ``timer``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.jobs import BATCH_JOBS, BATCH_SECONDS
from ..sources.work import ship
from .retries import stateful

COLUMNS = ["batch", "jobs", "first_id", "last_id", "closed_at", "closed_by"]


class Batcher:
    """One key's open batch.  What it holds does not grow with its jobs."""

    def __init__(self, size: int, wait_us: int, state: list | None = None):
        self.size, self.wait = size, wait_us
        # number of the batch, its jobs, its first and last id, time of the last job, time of the last close
        self.batch, self.n, self.first, self.last, self.at, self.closed = state or [0, 0, None, None, None, None]

    def state(self) -> list:
        return [self.batch, self.n, self.first, self.last, self.at, self.closed]

    def _close(self, at: int, by: str) -> tuple:
        row = (self.batch, self.n, self.first, self.last, at, by)
        self.batch, self.n, self.closed = self.batch + 1, 0, at
        return row

    def due(self) -> int | None:
        """When the timer would close the open batch."""
        return self.at + self.wait if self.n else None

    def timer(self, now: int) -> list[tuple]:
        """``now`` is a time up to which all jobs have been seen."""
        return [self._close(self.due(), "timer")] if self.n and self.due() < now else []

    def jobs(self, ids: np.ndarray, times: np.ndarray) -> list[tuple]:
        """Takes jobs in order of time; steps from batch to batch, not from job to job."""
        out, i, n = [], 0, len(times)
        if not n:
            return out
        if self.closed is None:
            self.closed = int(times[0])
        quiet = np.flatnonzero(np.diff(times) > self.wait)  # jobs after which the timer runs out
        while i < n:
            out += self.timer(int(times[i]))
            full = i + self.size - self.n - 1
            late = int(np.searchsorted(times, self.closed + self.wait, side="left"))
            k = np.searchsorted(quiet, i)
            still = int(quiet[k]) if k < len(quiet) else n
            j = min(full, max(late, i))
            stop = min(j, still, n - 1)
            if not self.n:
                self.first = ids[i].item()
            self.n, self.last, self.at = self.n + stop - i + 1, ids[stop].item(), int(times[stop])
            if stop == j:
                out.append(self._close(self.at, "count" if j == full else "time"))
            i = stop + 1
        return out


def batches(jobs: DataFrame, key: str, at: str, order: str, size: int = BATCH_JOBS, seconds: float = BATCH_SECONDS, until: datetime | str | None = None) -> DataFrame:
    """The batches of a table of jobs, in order of (time, ``order``); jobs after ``until``, and timers
    that end by then or later, are left out; by default all timers run out.

    The order is the meaning, so a key's rows stream through one task, sorted, and
    the task holds an Arrow batch of them and one open batch at a time.
    """
    ship(jobs.sparkSession)
    kind, id_kind = (jobs.schema[c].dataType.simpleString() for c in (key, order))
    wait = int(seconds * 1e6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_, any_ = None, None, False
        rows: list[tuple] = []

        def flush():
            nonlocal rows
            out = pd.DataFrame(rows, columns=["k", *COLUMNS])
            rows = []
            return out

        def end(limit):
            for r in open_.timer(limit):
                rows.append((now, *r))

        limit = np.iinfo(np.int64).max
        for f in frames:
            keys = f["k"].to_numpy()
            cut = np.flatnonzero(np.append(True, pd.Series(keys[1:]).ne(pd.Series(keys[:-1])).to_numpy() & ~(pd.isna(keys[1:]) & pd.isna(keys[:-1])))) if len(f) else []
            for a, b in zip(cut, [*cut[1:], len(f)]):
                k = None if pd.isna(keys[a]) else keys[a]
                if not any_ or k != now:
                    if any_:
                        end(limit)
                    now, open_, any_ = k, Batcher(size, wait), True
                rows += [(now, *r) for r in open_.jobs(f["id"].to_numpy()[a:b], f["us"].to_numpy()[a:b])]
                if "until" in f:
                    limit = int(f["until"].iloc[a])
            if rows:
                yield flush()
        if any_:
            end(limit)
            if rows:
                yield flush()

    if until is not None:
        jobs = jobs.where(F.col(at) <= F.lit(until).cast("timestamp"))
    cols = [F.col(key).alias("k"), F.col(order).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")]
    if until is not None:
        cols.append(F.unix_micros(F.lit(until).cast("timestamp")).alias("until"))
    ordered = jobs.select(*cols).repartition("k").sortWithinPartitions("k", "us", "id")
    found = ordered.mapInPandas(run, f"k {kind}, batch long, jobs long, first_id {id_kind}, last_id {id_kind}, closed_at long, closed_by string")
    return found.select(F.col("k").alias(key), "batch", "jobs", "first_id", "last_id", F.timestamp_micros("closed_at").alias("closed_at"), "closed_by")


class BatchJobs(StatefulProcessor):
    """Jobs wait until the watermark passes them, so that they are taken in order of time however they arrive."""

    def __init__(self, key: str, size: int, wait_us: int):
        self.key, self.size, self.wait = key, size, wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batcher", "open string, waiting string")

    def _load(self) -> tuple[list | None, list]:
        if not self.state.exists():
            return None, []
        open_, waiting = self.state.get()
        return json.loads(open_), json.loads(waiting)

    def _advance(self, key: tuple, open_: list | None, waiting: list, now: int) -> Iterator[pd.DataFrame]:
        waiting.sort()
        k = next((i for i, x in enumerate(waiting) if x[0] > now), len(waiting))
        taken, waiting = waiting[:k], waiting[k:]
        b = Batcher(self.size, self.wait, open_)
        rows = b.jobs(np.array([x[1] for x in taken]), np.array([x[0] for x in taken], np.int64)) + b.timer(now)
        self.state.update((json.dumps(b.state()), json.dumps(waiting)))
        # the next job, or the end of the open batch, whatever is first
        for at in sorted({x for x in (waiting[0][0] if waiting else None, b.due()) if x is not None})[:1]:
            self.handle.registerTimer(at // 1000 + 1)
        if rows:
            out = pd.DataFrame(rows, columns=COLUMNS)
            out.insert(0, self.key, [key[0]] * len(out))
            out["closed_at"] = pd.to_datetime(out["closed_at"], unit="us")
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        open_, waiting = self._load()
        new = pd.concat(list(rows))
        waiting += [[int(a), b.item() if hasattr(b, "item") else b] for a, b in zip(new["at_us"], new["job"])]
        yield from self._advance(key, open_, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, waiting = self._load()
        yield from self._advance(key, open_, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def batch_stream(jobs: DataFrame, key: str, at: str, order: str, size: int = BATCH_JOBS, seconds: float = BATCH_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The batches of a stream of jobs, as far as the watermark has come; jobs may come ``late``."""
    ship(jobs.sparkSession)
    stateful(jobs)
    kind, id_kind = (jobs.schema[c].dataType.simpleString() for c in (key, order))
    marked = jobs.withWatermark(at, late).select(key, F.unix_micros(at).alias("at_us"), F.col(order).alias("job"), at)
    return marked.groupBy(key).transformWithStateInPandas(
        BatchJobs(key, size, int(seconds * 1e6)), f"{key} {kind}, batch long, jobs long, first_id {id_kind}, last_id {id_kind}, closed_at timestamp, closed_by string", "Append", "EventTime"
    )
