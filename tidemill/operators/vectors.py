"""An inverted-file index over vectors: cells around centroids, of which a query probes a few.

The centroids are fitted on a sample of bounded size; every vector is indexed.
What a search finds depends on how many cells it probes: measure it with
``recall`` against ``search.vector_top_k``, which stays exact.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import ship
from . import nearest
from .search import top_k

#: Vectors that the centroids are fitted on, at most, and passes over them.
SAMPLE_ROWS = 20_000
ROUNDS = 10


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(col: pa.Array) -> np.ndarray:
    return _unit(np.array(col.to_pylist(), np.float32).reshape(len(col), -1))


def fit(vectors: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means on the first ``sample_rows`` vectors by a hash of (vec_id, embedding).

    Null and empty vectors teach nothing.
    """
    some = vectors.where(F.size("embedding") > 0).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    got = some.orderBy(F.xxhash64("vec_id", "embedding", F.lit(seed)), "vec_id").limit(sample_rows).toArrow()
    if not got.num_rows:
        return np.empty((0, 0), np.float32)
    x = _matrix(got.column("embedding").combine_chunks())
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=len(centers)) > 0
        centers = np.where(used[:, None], _unit(sums), centers)
    return centers.astype(np.float32)


def _nearest(centers: np.ndarray, name: str, out: str, probes: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                near = np.argsort(-(_matrix(part.column(name)) @ centers.T), axis=1, kind="stable")[:, :probes]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.record_batch([*part.columns, lists], names=[*b.schema.names, out])

    return run


def _probes(rows: DataFrame, centers: np.ndarray, name: str, probes: int) -> DataFrame:
    ship(rows.sparkSession)
    ready = rows.where(F.size(name) > 0).withColumn(name, F.col(name).cast("array<float>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema) + ", cells array<int>"
    return ready.mapInArrow(_nearest(centers, name, "cells", probes), schema)


def _cells(rows: DataFrame, centers: np.ndarray, name: str, probes: int) -> DataFrame:
    return _probes(rows, centers, name, probes).withColumn("cell", F.explode("cells")).drop("cells")


def index(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, embedding) with the cell of each; null and empty vectors are left out."""
    return _cells(vectors.select("vec_id", "embedding"), centers, "embedding", 1)


def search_index(indexed: DataFrame, centers: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 4, threshold: float | None = None) -> DataFrame:
    """Top k by cosine among the vectors of the ``probes`` cells nearest to each query: query_id, vec_id, score, rank.

    The queries go to the vectors in blocks of bounded bytes, each with its cells, and
    tasks multiply a cell's vectors by the queries that probe it: no vector moves to its
    cell, so a large cell is no large task.  A vector is not its own neighbour.
    """
    asked = _probes(queries.select("query_id", "q"), centers, "q", probes)
    parts = []
    for hits in nearest.candidates(indexed, asked, k, threshold):
        if threshold is not None:
            hits = hits.where(F.col("score") >= threshold)
        parts.append(top_k(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k))
    return reduce(DataFrame.unionByName, parts)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hit = found.select("query_id", "vec_id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("pairs"))
