"""Language identification with a byte convolutional network in numpy.

The network: byte embeddings followed by filters of several widths (kept folded
together as one table of filter responses per byte value and offset), maximum
pooling over a fixed-length window, a dense layer and softmax.  It is trained
here on windows of labelled texts and applied to all windows of every text; a
text's prediction is the mean of its windows' probabilities, each weighted by
its number of letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Work, buffer_of, lower, mix, shards, ship, small, tidy

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 10
#: Bounds of the training sample: documents, and windows of each.
SAMPLE_DOCS = 3000
#: Training documents of each language, at least, as far as there are so many.
LEAST_DOCS = 50
SAMPLE_WINDOWS = 4
#: Windows handled at once.
CHUNK = 2048

_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[192:] = 1  # lead bytes: one for each non-ASCII character


@dataclass
class ByteCnn:
    classes: list[str]
    window: int = WINDOW
    widths: tuple[int, ...] = WIDTHS
    filters: int = FILTERS
    tables: list[np.ndarray] = field(default_factory=list)  # (width, 256, filters) each
    dense: np.ndarray | None = None
    bias: np.ndarray | None = None

    def start(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3 / w, (w, 256, self.filters)).astype(np.float32) for w in self.widths]
        self.dense = rng.normal(0, 0.2, (self.filters * len(self.widths), len(self.classes))).astype(np.float32)
        self.bias = np.zeros(len(self.classes), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross-entropy; x holds (n, window) bytes."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.dense, self.bias]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), batch):
                b = order[s : s + batch]
                xb, step = x[b].astype(np.int64), step + 1
                pooled, where = [], []
                for w, t in zip(self.widths, self.tables):
                    n = self.window - w + 1
                    a = sum(t[j][xb[:, j : j + n]] for j in range(w))
                    where.append(p := a.argmax(axis=1))
                    pooled.append(np.take_along_axis(a, p[:, None, :], axis=1)[:, 0])
                z = np.concatenate(pooled, axis=1)
                act = np.maximum(z, 0)
                logits = act @ self.dense + self.bias
                prob = np.exp(logits - logits.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                prob[np.arange(len(b)), y[b]] -= 1
                prob /= len(b)
                back = (prob @ self.dense.T) * (z > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                rows, cols = np.arange(len(b))[:, None], np.arange(self.filters)[None, :]
                for k, w in enumerate(self.widths):
                    g = back[:, k * self.filters : (k + 1) * self.filters]
                    for j in range(w):
                        np.add.at(grads[k][j], (xb[rows, where[k] + j], np.broadcast_to(cols, g.shape)), g)
                grads += [act.T @ prob, prob.sum(axis=0)]
                for p, g, a, v in zip(params, grads, m1, m2):
                    a *= 0.9
                    a += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def pairs(self) -> list[np.ndarray]:
        """Filter responses by pairs of bytes, so that two bytes cost one look-up."""
        out = []
        for w, t in zip(self.widths, self.tables):
            for j in range(0, w - 1, 2):
                out.append((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1))
            if w % 2:
                out.append(t[w - 1])
        return out

    def probabilities(self, x: np.ndarray, looked: list[np.ndarray]) -> np.ndarray:
        """(n, classes) of (n, window) bytes."""
        flat = x.ravel()
        two = np.zeros(len(flat), np.uint16)
        two[:-1] = (flat[:-1].astype(np.uint16) << 8) | flat[1:]
        pooled, k = [], 0
        for w in self.widths:
            n = len(flat) - w + 1
            a = None
            for j in range(0, w, 2):
                part = looked[k].take(two[j : j + n] if j + 1 < w else flat[j : j + n], axis=0)
                a = part if a is None else np.add(a, part, out=a)
                k += 1
            full = np.full((len(flat), self.filters), -np.inf, np.float32)
            full[:n] = a
            pooled.append(full.reshape(len(x), self.window, self.filters)[:, : self.window - w + 1].max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int):
    """All windows of all rows, the last of each filled with zeros, in chunks: (bytes, row of each)."""
    size = np.diff(offsets)
    count = -(-size // window)
    row = np.repeat(np.arange(len(size)), count)
    begin = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
    end = np.minimum(begin + window, offsets[1:][row])
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    reach = np.arange(window)
    for s in range(0, len(row), CHUNK):
        x = padded[begin[s : s + CHUNK, None] + reach]
        x[reach >= (end - begin)[s : s + CHUNK, None]] = 0
        yield x, row[s : s + CHUNK]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data] > 0)])
    some = total[offsets[1:]] > total[offsets[:-1]]
    plain = (data >= 65) & (data < 123) & ((data < 91) | (data > 96))
    ascii_total = np.concatenate([[0], np.cumsum(plain)])
    sure = ascii_total[offsets[1:]] > ascii_total[offsets[:-1]]
    for i in np.flatnonzero(some & ~sure):
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def _predict(sent):
    looked: list[np.ndarray] = []

    def run(batches):
        net: ByteCnn = sent.value
        if not looked:
            looked.extend(net.pairs())
        names = pa.array([*net.classes, "und"])
        for batch in batches:
            text = batch.column("text")
            data, offsets = buffer_of(text)
            best = np.full(batch.num_rows, len(net.classes))
            score = np.zeros(batch.num_rows)
            for i, j in shards(offsets):
                part, off = lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                total, weight = np.zeros((j - i, len(net.classes))), np.zeros(j - i)
                for x, row in windows_of(part, off, net.window) if net.classes else ():
                    p = net.probabilities(x, looked)
                    w = _LETTER[x].sum(axis=1) + 1e-3
                    np.add.at(total, row, p * w[:, None])
                    np.add.at(weight, row, w)
                ok = _has_letter(part, off)
                if net.classes:
                    mean = total / np.maximum(weight, 1e-9)[:, None]
                    best[i:j] = np.where(ok, mean.argmax(axis=1), len(net.classes))
                    score[i:j] = np.where(ok, mean.max(axis=1), 0.0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([batch.column(c) for c in keep] + [names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    return tidy(run)


def _take_windows(window: int, each: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                spots = mix(np.arange(each, dtype=U64) + U64(b - a) * U64(977))
                for k in range(each):
                    at = a + int(spots[k] % U64(max(1, b - a - window + 1)))
                    size = window if k % 2 == 0 else 16 + int(spots[k] >> U64(40)) % (window - 16)
                    out.append((i, data[at : min(b, at + size)].tobytes()))
            yield pa.record_batch([batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.binary())], names=["lang", "piece"])

    return run


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, seed: int = 1) -> ByteCnn:
    """Trains on ``sample_docs`` different rows of ``labelled`` (doc_id, text, lang), the first by a hash of doc_id and text, and on ``LEAST_DOCS`` of each language at least.

    Null langs and null or empty texts teach nothing; repeats of a row count once,
    before rows are chosen, so reruns learn the same and no language is crowded out.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    different = rows.select("h", "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = different.withColumn("_nth", nth).where(F.col("_nth") <= LEAST_DOCS).drop("_nth")
    top = different.orderBy("h", "lang").limit(sample_docs).unionByName(few).distinct()
    top = Work(labelled.sparkSession, "language").table(top, "chosen")
    some = rows.join(small(top, top.count()), ["h", "lang"]).dropDuplicates(["h", "lang"])
    pieces = some.select("lang", "text").mapInArrow(_take_windows(WINDOW, sample_windows), "lang string, piece binary")
    got = sorted((r["lang"], bytes(r["piece"])) for r in pieces.collect())
    classes = sorted({r[0] for r in got})
    net = ByteCnn(classes)
    net.start(seed)
    if classes:
        x = np.zeros((len(got), WINDOW), np.uint8)
        for i, (_, piece) in enumerate(got):
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        net.train(lower(x), np.array([classes.index(r[0]) for r in got]), seed=seed)
    return net


def predict(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """``docs`` with its text replaced by lang_pred and score.

    lang_pred is ``und`` with score 0 for a null text or one without letters, and
    for all rows if nothing was learned.  Only the text is looked at.
    """
    ship(docs.sparkSession)
    cols = [c for c in docs.columns if c != "text" and c not in ("lang_pred", "score")]
    ready = docs.select(*cols, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return ready.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(net)), f"{schema}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2").select("doc_id", "text", "lang")


def _accept(sent, least: float):
    guess = _predict(sent)

    def run(batches):
        for batch in batches:
            out = next(iter(guess(iter([batch.select(["text"])]))))
            ok = [p != "und" and s >= least for p, s in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return tidy(run)


def accept(docs: DataFrame, net: ByteCnn, least: float = 0.35) -> DataFrame:
    """``docs`` in its own columns without the rows whose language cannot be told (``und``, or a score under ``least``).

    Null texts and texts without letters go; rows that repeat are decided alike.
    """
    ship(docs.sparkSession)
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(net), least), docs.schema)
