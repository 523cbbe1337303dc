"""Document quality by compression with two zstandard dictionaries.

One dictionary is trained on good labelled text and one on bad.  A text is cut
into blocks, each compressed with either; the normalised difference of the
compressed sizes is turned into a probability by a logistic curve fitted on
whole texts of labelled rows that built neither dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, buffer_of, ship, tidy

BLOCK = 512
LEVEL = 6
DICTIONARY = 128 << 10
#: Bounds of the training sample: labelled rows of each class, and the bytes that a dictionary learns from in each,
#: in slices of ``SLICE`` spread evenly from the first byte to the last (a shorter text is learned whole).
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 8192
SLICE = 1024


@dataclass
class CompressionModel:
    good: bytes = b""
    bad: bytes = b""
    weight: float = 0.0
    bias: float = 0.0

    def compressors(self):
        """A compressor for each dictionary, digested once; none if nothing was learned."""
        out = []
        for raw in (self.good, self.bad):
            if not raw:
                return None, None
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out[0], out[1]

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight * x + self.bias, -30, 30))))


def difference(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / bytes of text; 0 for an empty text.

    Divided by the text's length, not by the compressed sizes: endless repetition
    compresses to almost nothing with either dictionary and must stay near 0.
    """
    if not text or good is None:
        return 0.0
    a = b = 0
    for s in range(0, len(text), BLOCK):
        part = text[s : s + BLOCK]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - a) / len(text)


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """The content of a dictionary trained on ``samples``: what occurs in most of them, by zstandard's cover algorithm.

    With less text than would fill it, the dictionary is that text.
    """
    samples = [s for s in samples if s]
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8, f=20, split_point=1.0, accel=1, steps=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little repeats: the samples in turn
        return b"".join(samples)[:size]


def slices(text: bytes, limit: int = SAMPLE_BYTES, each: int = SLICE) -> list[bytes]:
    """Slices of a text, spread evenly over all of it; the whole text if it is no longer than ``limit``."""
    if len(text) <= limit:
        return [text]
    count = limit // each
    return [text[(k * (len(text) - each)) // (count - 1) :][:each] for k in range(count)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Weight and bias of a logistic curve, by damped Newton steps with a small ridge."""
    w = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * x).sum() + 1e-3 * w, (p - y).sum() + 1e-3 * b])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5.0 / max(1e-9, np.abs(d).max()))
        w, b = w - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(w), float(b)


def _learn(limit: int):
    """The slices of texts that go into a dictionary."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            rows = [(i, k, x) for i in range(batch.num_rows) for k, x in enumerate(slices(data[offsets[i] : offsets[i + 1]].tobytes(), limit))]
            cols = [batch.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in ("quality", "h", "t")]
            yield pa.record_batch([*cols, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["quality", "h", "t", "k", "piece"])

    return tidy(run)


def _measure(sent):
    """The size difference of whole texts."""

    def run(batches):
        pair = sent.value.compressors()
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            x = [difference(memoryview(data[offsets[i] : offsets[i + 1]]), *pair) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("quality"), pa.array(x, pa.float64())], names=["quality", "x"])

    return tidy(run)


def chosen_rows(docs: DataFrame, labels: DataFrame, sample_docs: int, seed: int) -> DataFrame:
    """(quality, h, t, text): at most ``sample_docs`` labelled rows of each class, the first by a hash of doc_id and text.

    Ids with both labels teach nothing; null and empty texts and repeats of a row are left out.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
    known = known.where("quality = other").select("doc_id", "quality")
    rows = docs.where("text is not null and length(text) > 0").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("t", F.xxhash64("text"))
    ids = rows.select("doc_id", "h", "t").join(known, "doc_id")
    picked = None
    for k in (1, 0):
        top = ids.where(F.col("quality") == k).select("quality", "h", "t", "doc_id").distinct().orderBy("h", "doc_id", "t").limit(sample_docs)
        picked = top if picked is None else picked.unionByName(top)
    # at most 2 * sample_docs rows
    return rows.join(F.broadcast(picked), ["doc_id", "h", "t"]).dropDuplicates(["doc_id", "h", "t"]).select("quality", "h", "t", "text")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, seed: int = 3) -> CompressionModel:
    """Learns from the ``chosen_rows``.

    Every other one (by its hash) goes into the dictionaries, by at most
    ``sample_bytes`` from all over its text; the curve is fitted on the whole texts
    of the others.  What reaches the driver is bounded by the two parameters.  With
    a class missing, every text scores the share of label 1.
    """
    spark = docs.sparkSession
    ship(spark)
    # materialised: two small passes read it
    rows = Work(spark, "quality").table(chosen_rows(docs, labels, sample_docs, seed), "rows")
    odd = F.col("h").bitwiseAND(F.lit(1)) == 1
    pieces = rows.where(~odd).mapInArrow(_learn(sample_bytes), "quality int, h long, t long, k int, piece binary").collect()
    got = {k: [bytes(r["piece"]) for r in sorted(p for p in pieces if p["quality"] == k)] for k in (1, 0)}
    model = CompressionModel(dictionary(got[1]), dictionary(got[0]))
    if not model.good or not model.bad:
        n = rows.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
        share = (n[0] + 1) / (n[1] + 2)
        return CompressionModel(bias=float(np.log(share / (1 - share))))
    rest = rows.where(odd).select("quality", "text").mapInArrow(_measure(spark.sparkContext.broadcast(model)), "quality int, x double").collect()
    if {r["quality"] for r in rest} != {0, 1}:  # nothing is left to fit a curve on
        rest = rows.select("quality", "text").mapInArrow(_measure(spark.sparkContext.broadcast(model)), "quality int, x double").collect()
    rest = sorted((r["x"], r["quality"]) for r in rest)
    model.weight, model.bias = logistic(np.array([r[0] for r in rest]), np.array([r[1] for r in rest], float))
    return model


def _score(sent, threshold: float):
    ready: list = []

    def run(batches):
        model: CompressionModel = sent.value
        if not ready:
            ready.extend(model.compressors())
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            raw = memoryview(data)
            score = [model.probability(difference(raw[offsets[i] : offsets[i + 1]], *ready)) for i in range(batch.num_rows)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch(
                [batch.column(c) for c in keep] + [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=[*keep, "score", "predicted"]
            )

    return tidy(run)


def score(docs: DataFrame, model: CompressionModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with its text replaced by score and predicted; a null text scores as an empty one."""
    ship(docs.sparkSession)
    cols = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    ready = docs.select(*cols, F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), f"{schema}, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where("pmod(crc32(cast(doc_id as string)), 5) <> 0")
