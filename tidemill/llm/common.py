"""Shared helpers: the shared work folder, checked broadcasts, byte-level text scanning.

The scanners work on the UTF-8 bytes of whole Arrow batches with numpy.  Every
word class used by the operators is a class of ASCII bytes plus "all bytes of
non-ASCII characters", so scanning bytes gives the same words as scanning
code points.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import ship as _send

U64 = np.uint64
#: Rows up to which a table may be broadcast after its rows were counted.
BROADCAST_ROWS = 200_000
#: Bytes of text handled at once inside a Python task.
SHARD_BYTES = 1 << 20


#: Bytes of rows that Spark hands to a Python task at once, unless the session asks for less.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets the executors import this package, and bounds the bytes of a batch on both sides of a Python task.

    Spark's own bound counts 64 MB a batch; a task holds it several times over.
    """
    _send(spark)
    said = str(spark.conf.get(_BATCH)).rstrip("bB")
    if not said.isdigit() or not 0 < int(said) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


# ---------------------------------------------------------------- work folder
def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster without it, the warehouse (shared by definition) is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return root.rstrip("/")


class Work:
    """A fresh subfolder of the shared folder, and tables written into it."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{work_root(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage."""
        self.n += 1
        at = f"{self.path}/{self.n}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``table`` returned and nothing reads any more."""
        jvm = self.spark._jvm
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``bound``; else as it is."""
    return F.broadcast(df) if rows <= bound else df


# ---------------------------------------------------------------- memory
def release() -> None:
    """Gives freed memory back to the system: a Python worker is used again and would else keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """``run``, a function over an iterator of batches, which releases memory when its task ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


# ---------------------------------------------------------------- text buffers
def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (wide or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def shards(offsets: np.ndarray, limit: int = SHARD_BYTES):
    """Ranges of whole rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of [^\x20\x09-\x0D]
VISIBLE = np.ones(256, bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row (and one more) the index of its first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    m = kind[data]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = m[:-1]
    cut = offsets[:-1]
    prev[cut[cut < n]] = False
    starts = np.flatnonzero(m & ~prev)
    prev[:-1] = m[1:]
    prev[-1] = False
    cut = offsets[1:]
    prev[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(m & ~prev) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15
_BYTE = stream(7, 256) | U64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for spans of up to ``SHARD_BYTES`` bytes; made once."""
    if not _powers:
        p = np.full(SHARD_BYTES + 1, _BASE, U64)
        q = np.full(SHARD_BYTES + 1, pow(_BASE, -1, 1 << 64), U64)
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(p), np.cumprod(q)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte codes, mixed."""
    if not len(starts):
        return np.empty(0, U64)
    n = len(data)
    if n > SHARD_BYTES:  # one very long text: piece by piece, cut between words
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SHARD_BYTES, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            if b - a > SHARD_BYTES:  # one word of more than a MB
                out.append(np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little")], U64))
            else:
                out.append(span_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a))
            i = j
        return np.concatenate(out)
    p, q = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        h = np.empty(n + 1, U64)
        h[0] = 0
        np.cumsum(_BYTE[data] * p[:n], out=h[1:])
        return mix((h[ends] - h[starts]) * q[starts])
