"""Named streams that a later call continues, with every row written once.

A stream's checkpoint and its output stand under its name in the shared folder.
Each micro-batch is a table of its own, so one that is run again after a failure
replaces itself; readers see the micro-batches that the checkpoint has committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.work import folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/streams/{name}"


def advance(name: str, stream: DataFrame, mode: str = "append", after_write: Callable[[int], None] | None = None) -> None:
    """Runs ``stream`` from where ``name`` stopped over all that is there now.

    ``after_write`` is called between a micro-batch's write and its commit; what it
    raises ends the run, and the next one writes that micro-batch again.
    """
    at = _place(stream.sparkSession, name)

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        if after_write:
            after_write(epoch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def committed(spark: SparkSession, name: str) -> list[int]:
    """Micro-batches that are committed, by the checkpoint."""
    return sorted(int(x) for x in _names(spark, f"{_place(spark, name)}/state/commits") if x.isdigit())


def written(spark: SparkSession, name: str, schema: T.StructType, mode: str = "append") -> DataFrame:
    """What the stream has written so far: all micro-batches, or the last one in complete mode."""
    at = _place(spark, name)
    epochs = committed(spark, name)
    # old commits may be cleaned up, their output is not: every epoch before a committed one is committed
    there = {int(x.partition("=")[2]) for x in _names(spark, f"{at}/out") if x.startswith("epoch=")}
    wanted = sorted(e for e in there if epochs and e <= epochs[-1])
    if mode == "complete":
        wanted = wanted[-1:]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{at}/out/epoch={e}" for e in wanted])


def forget(spark: SparkSession, name: str) -> None:
    """Deletes a stream's output and where it stopped."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_place(spark, name))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
