"""Sending this package to the executors, and cutting a plan's lineage through the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package: sent once per Spark context, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tidemill-py-"), "tidemill_src.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for x in sorted(names):
                if x.endswith(".py"):
                    z.write(f := os.path.join(d, x), os.path.relpath(f, os.path.dirname(top)))
    sc.addPyFile(to)
    sc._tidemill_sent = True
