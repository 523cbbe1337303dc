"""Versioned tables in the shared folder, with aliases and retention.

A version is a folder of Parquet files that nothing changes once it is complete.
Writers claim the next number by creating a file, which only one of them can.  An
alias is a folder of empty files named ``<step>=<version>``; the largest step
holds, so a switch is the creation of one file and a reader, who resolves the
alias once, gets one version whole.  Nothing relies on renaming, which object
stores lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import folder

CURRENT = "current"


class Store:
    """The tables under one name space of the shared folder."""

    def __init__(self, spark: SparkSession, space: str):
        self.spark = spark
        self.root = f"{folder(spark)}/tables/{space}"
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}" if at else self.root)

    def _names(self, at: str) -> list[str]:
        p = self._path(at)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _claim(self, at: str) -> bool:
        """Creates an empty file; false if it was there."""
        self.fs.mkdirs(self._path(at).getParent())
        try:
            return self.fs.createNewFile(self._path(at))
        except Exception as taken:  # some stores raise instead
            if "AlreadyExists" in str(taken):
                return False
            raise

    # ------------------------------------------------------------ tables
    def create(self, table: str, schema: T.StructType) -> bool:
        """Makes an empty table as version 0; true if it was not there.  Its schema holds for all versions."""
        if not self._claim(f"{table}/versions/0.claim"):
            return False
        self.spark.createDataFrame([], schema).write.parquet(f"{self.root}/{table}/v=0")
        self.switch(table, 0)
        return True

    def versions(self, table: str) -> list[int]:
        """Complete versions, oldest first."""
        found = [int(x[2:]) for x in self._names(table) if x.startswith("v=")]
        return sorted(n for n in found if self.fs.exists(self._path(f"{table}/v={n}/_SUCCESS")))

    def write(self, table: str, rows: DataFrame) -> int:
        """A new version; no alias names it yet."""
        known = [int(x.partition(".")[0]) for x in self._names(f"{table}/versions")]
        n = max(known, default=-1) + 1
        while not self._claim(f"{table}/versions/{n}.claim"):
            n += 1
        rows.write.parquet(f"{self.root}/{table}/v={n}")
        return n

    def switch(self, table: str, version: int, alias: str = CURRENT) -> None:
        """Lets ``alias`` name a complete version from now on."""
        if version not in self.versions(table):
            raise ValueError(f"{table} has no complete version {version}")
        while True:
            step = max((int(x.partition("=")[0]) for x in self._names(f"{table}/aliases/{alias}")), default=-1) + 1
            if self._claim(f"{table}/aliases/{alias}/{step:012d}={version}"):
                return

    def drop_alias(self, table: str, alias: str) -> None:
        self.fs.delete(self._path(f"{table}/aliases/{alias}"), True)

    def resolve(self, table: str, alias: str = CURRENT) -> int:
        steps = self._names(f"{table}/aliases/{alias}")
        if not steps:
            raise LookupError(f"{table} has no alias {alias}")
        return int(steps[-1].partition("=")[2])

    def read(self, table: str, alias: str = CURRENT) -> DataFrame:
        """The rows of the version that ``alias`` names now; later switches do not touch them."""
        return self.version(table, self.resolve(table, alias))

    def version(self, table: str, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/v={n}")

    def retain(self, table: str, newest: int) -> list[int]:
        """Deletes all but the newest versions and those an alias names; returns what is left."""
        named = {self.resolve(table, a) for a in self._names(f"{table}/aliases")}
        complete = self.versions(table)
        for n in complete[: max(0, len(complete) - newest)]:
            if n not in named:
                self.fs.delete(self._path(f"{table}/v={n}"), True)
        return self.versions(table)

    def drop(self, table: str) -> None:
        self.fs.delete(self._path(table), True)


# ---------------------------------------------------------------- benchmark results
class Benchmarks:
    """Results of benchmark runs: a version for each run, read newest first."""

    def __init__(self, spark: SparkSession, space: str):
        self.store, self.table = Store(spark, space), "benchmarks"

    def save(self, results: DataFrame) -> int:
        return self.store.write(self.table, results)

    def recent(self, runs: int) -> DataFrame | None:
        """The newest ``runs`` runs with their number, ``run``; none if there is none."""
        out = None
        for n in self.store.versions(self.table)[::-1][:runs]:
            rows = self.store.version(self.table, n).withColumn("run", F.lit(n))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def reset(self) -> None:
        self.store.drop(self.table)
