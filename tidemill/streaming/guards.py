"""Rate limits and budgets, in batch and as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import cut, ship
from . import resume

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def attempts_in(events: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Adds the attempts of the key in the window that ends at each event."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("attempts", F.count("*").over(w))


def running_budget(events: DataFrame, unit: str, amount: str, limit: float | None, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Adds what was spent in the event's day or hour so far, and whether that is within ``limit``."""
    bucket = F.date_trunc(unit, ts)
    group = [*(keys or []), "bucket"]
    # slices in order of time, so that no day has to fit one task; written once, as a slice's bounds come from a sample
    dealt = events.withColumn("bucket", bucket).repartitionByRange(*group, ts, "event_id").withColumn("_slice", F.spark_partition_id())
    dealt = cut(dealt, events.sparkSession)
    sums = dealt.groupBy(*group, "_slice").agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_slice")
    # only the first group of a slice began in an earlier one, so these rows are no more than the slices
    carried = sums.withColumn("_before", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_nth", F.row_number().over(w)).where("_nth > 1")
    same = F.col("d._slice") == F.col("c._slice")
    for k in group:
        same &= F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
    out = dealt.alias("d").join(F.broadcast(carried.alias("c")), same, "left").select("d.*", "c._before")
    so_far = F.sum(amount).over(Window.partitionBy(*group, "_slice").orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0))
    # a sum of nulls only is null
    spent = F.when(F.col("_before").isNull(), so_far).otherwise(F.col("_before") + F.coalesce(so_far, F.lit(0)))
    out = out.withColumn("spent", spent).drop("_slice", "_before")
    return out.withColumn("allowed", F.lit(True) if limit is None else F.col("spent") <= limit)


def admitted(events: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """Sliding limit that counts admitted events only; the order matters, so each key is a fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        recent, ok, span = deque(), [], pd.Timedelta(seconds=seconds)
        for at in pdf["ts"]:
            while recent and recent[0] <= at - span:
                recent.popleft()
            ok.append(len(recent) < limit)
            if ok[-1]:
                recent.append(at)
        return pdf.assign(admitted=ok)

    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts").groupBy(key).applyInPandas(fold, f"{key} {kind}, event_id long, ts timestamp, admitted boolean")


def admitted_stream(events: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """The same over a stream; state holds the admitted times of the last window of each key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok = []
        for at in pdf["ts"]:
            now = at.timestamp()
            recent = [x for x in recent if x > now - seconds]
            ok.append(len(recent) < limit)
            if ok[-1]:
                recent.append(now)
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(pdf), "event_id": pdf["event_id"].to_numpy(), "admitted": ok})

    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, sf_dir: str, schema: str = EVENTS) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def replay(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a streaming plan over all events that are there now and returns what it wrote."""
    name = f"replay-{uuid.uuid4().hex}"
    planned = plan(event_stream(spark, sf_dir))
    resume.advance(name, planned, mode)
    return resume.written(spark, name, planned.schema, mode)


def distinct_stream(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The first event of each key; a key is forgotten when the watermark passes its first event by ``ttl``."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """First forwarded address, else the real one, else the peer: the key of a rate limit."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(F.length(first) > 0, first), real, peer)
