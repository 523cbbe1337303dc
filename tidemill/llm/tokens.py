"""Token ids in a bit-packed binary format.

File format (a Parquet table, so any store that Spark reads can hold it and a
lost task's file is never half visible).  One row is a block of whole documents:

    shard     long    shards follow one another in doc_id order
    block     long    position of the block in its shard
    start     long    ids of the shard before this block
    doc_ids   array   ids of the block's documents, ascending
    lengths   array   token counts of those documents, with the end id
    bits      int     width of an id: the least that holds the vocabulary
    payload   binary  the ids, ``bits`` bits each, least significant bit first

Every id has a known bit offset, so a block is unpacked as a whole by numpy, and
any slice of it without the rest.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Work, buffer_of, mix, shards, ship, small, span_hashes, tidy

#: Ids after which a block ends (whole documents, so a block may be longer).
BLOCK_IDS = 1 << 16
#: Bytes of text to a shard, about, and sampled rows by which the shards of equal bytes are cut.
SHARD_TEXT = 16 << 20
SAMPLE_ROWS = 64
#: Bytes of pieces of text and their ids that a Python worker remembers, each counted with ``OVERHEAD``; longer pieces than ``LONG`` are not kept.
CACHE_BYTES = 96 << 20
OVERHEAD = 160
LONG = 64


def default_tokenizer() -> str:
    """The public byte-level vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- packing
def bits_for(vocabulary: int) -> int:
    """Least width of an id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, least significant bit first."""
    ids = np.asarray(ids, np.uint64)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = np.zeros((len(ids) * bits + 7) // 8 + 8, np.uint8)
    for s in range(0, len(ids), 1 << 20):  # a multiple of 8 ids ends on a byte
        part = ids[s : s + (1 << 20)]
        flags = (part[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
        raw = np.packbits(flags.ravel(), bitorder="little")
        out[s * bits // 8 : s * bits // 8 + len(raw)] = raw
    return out[: (len(ids) * bits + 7) // 8].tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first``, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    lo = int(at[0] // 8) if count else 0
    raw = np.frombuffer(payload, np.uint8)[lo : ((first + count) * bits + 7) // 8]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    byte = at // 8 - lo
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at % 8).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ---------------------------------------------------------------- encoding
#: White space beyond ASCII's, and separators some engines count as such: such texts are encoded in one piece,
#: and so are those with numbers that are no decimal digits, which are word characters here but not there.
_ODD_CODES = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD_CODES += [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("No", "Nl")]
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")
#: Beyond the first plane all are: a class of both would be searched range by range.
_FAR = re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]")
_BLANK = " \t\n\x0b\x0c\r"
#: Letters, and numbers that are no decimal digits, of the first plane; listed, because a listed class is searched fastest.
_LETTERS = "".join(c for c in map(chr, range(0x10000)) if re.match(r"[^\W\d_]", c))
_PIECE = re.compile(rf" [{_LETTERS}]+|[{_BLANK}]*[{_LETTERS}]+|[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: A piece that is one pre-token whatever precedes it.
_SIMPLE = re.compile(r" [^\W\d_]+")


class Encoder:
    """Encodes with the tokenizers library; pieces of text that came before are looked up.

    A byte-level pre-tokenizer ends a token between a visible character and a
    blank, and after letters before anything else, so the ids of a text are those
    of its pieces in turn.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.piecewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        # a special token in a text must stay in one piece
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = max(self.tok.get_vocab_size(with_added_tokens=True), 1)
        self.kind = "<u2" if bits_for(self.size) <= 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        # a simple piece has a blank at its start only, which a byte-level vocabulary writes so
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that were not seen before; simple ones as one text, told apart by the ids that begin with a blank."""
        out: dict[str, bytes] = {}
        simple, rest = [], []
        for p in new:
            (simple if len(p) <= LONG and _SIMPLE.fullmatch(p) else rest).append(p)
        for s in range(0, len(simple), 5000):
            part = simple[s : s + 5000]
            ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.append(np.flatnonzero(self.opens[ids]), len(ids)).tolist()
            if len(cut) != len(part) + 1:
                rest += part
                continue
            raw, w = ids.tobytes(), ids.itemsize
            out.update((p, raw[cut[k] * w : cut[k + 1] * w]) for k, p in enumerate(part))
        out.update(zip(rest, self.whole(rest)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of two bytes, or four for a large vocabulary."""
        if not self.piecewise:
            return self.whole(texts)
        known = self.known
        out: list[bytes | None] = []
        left: dict[int, list[str]] = {}
        for n, t in enumerate(texts):
            if _ODD.search(t) or _FAR.search(t) or any(x in t for x in self.special):
                out.append(self.whole([t])[0])
                continue
            pieces = _PIECE.findall(t)
            try:
                out.append(b"".join(map(known.__getitem__, pieces)))
            except KeyError:
                out.append(None)
                left[n] = pieces
        if left:
            new = {p for pieces in left.values() for p in pieces if p not in known}
            got = self.learn(sorted(new))
            keep = {p: x for p, x in got.items() if len(p) <= LONG}
            cost = sum(map(len, keep)) + sum(map(len, keep.values())) + OVERHEAD * len(keep)
            here = {p: known[p] for pieces in left.values() for p in pieces if p in known} | got if self.held + cost > CACHE_BYTES or len(keep) < len(got) else None
            if self.held + cost > CACHE_BYTES:
                known.clear()
                self.held = 0
            if cost <= CACHE_BYTES:
                known.update(keep)
                self.held += cost
            look = (known if here is None else here).__getitem__
            for n, pieces in left.items():
                out[n] = b"".join(map(look, pieces))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file; what it remembers serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_LEAST = np.iinfo(np.int64).min


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A signed 64-bit hash of each whole text (null: empty), by which rows that repeat a doc_id are ordered."""
    data, offsets = buffer_of(texts)
    out = []
    for i, j in shards(offsets):
        a, b = offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        out.append(mix(span_hashes(data[offsets[i] : offsets[j]], a, b) + (b - a).astype(U64)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


class Cuts:
    """Where shards begin, in order of (doc_id, text hash)."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids, self.hashes = ids, hashes

    def shard(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of cuts at or before each row."""
        lo, hi = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        for k in np.flatnonzero(hi > lo):  # a cut inside the rows of one doc_id
            lo[k] += np.searchsorted(self.hashes[lo[k] : hi[k]], hashes[k], side="right")
        return lo


def _keys(batches):
    for batch in batches:
        ids = batch.column(0).fill_null(int(_LEAST))
        data, offsets = buffer_of(batch.column(1))
        yield pa.record_batch([ids, pa.array(text_hashes(batch.column(1))), pa.array(np.diff(offsets))], names=["i", "h", "bytes"])


def cuts(docs: DataFrame, wanted: int, rows: int) -> Cuts:
    """Cuts of ``docs`` into about ``wanted`` shards of equal bytes, by a sample of rows chosen by a hash of the row.

    The driver sees ``SAMPLE_ROWS`` rows to a shard, about; a shard exceeds its share by long texts only.
    """
    if wanted <= 1:
        return Cuts(np.empty(0, np.int64), np.empty(0, np.int64))
    share = max(1, rows // (wanted * SAMPLE_ROWS))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0) if share > 1 else docs
    got = np.array(some.mapInArrow(tidy(_keys), "i long, h long, bytes long").collect(), np.int64).reshape(-1, 3)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    upto = np.cumsum(got[:, 2] + 16)
    at = np.unique(np.searchsorted(upto, np.arange(1, wanted) * (upto[-1] / wanted))) if len(got) else np.empty(0, np.int64)
    at = at[at < len(got)]
    return Cuts(got[at, 0], got[at, 1])


def _encode(path: str, sent, end_id: int):
    def run(batches):
        enc = encoder(path)
        tail = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            order = text_hashes(batch.column("text"))
            shard = sent.value.shard(ids.fill_null(int(_LEAST)).to_numpy(zero_copy_only=False), order)
            for s in range(0, batch.num_rows, 512):
                data = [b + tail for b in enc.encode([t or "" for t in batch.column("text").slice(s, 512).to_pylist()])]
                yield pa.record_batch([ids.slice(s, 512), pa.array(shard[s : s + 512], pa.int64()), pa.array(order[s : s + 512]), pa.array(data, pa.binary())], names=["doc_id", "shard", "h", "ids"])

    return tidy(run)


def _blocks(bits: int, limit: int):
    small_id = "<u2" if bits <= 16 else "<u4"

    def run(batches):
        shard, block, start, ids, lens, data = None, 0, 0, [], [], []

        def row():
            packed = pack(np.frombuffer(b"".join(data), small_id), bits)
            cols = [pa.array([x], t) for x, t in ((shard, pa.int64()), (block, pa.int64()), (start, pa.int64()), (ids, pa.list_(pa.int64())), (lens, pa.list_(pa.int64())), (bits, pa.int32()), (packed, pa.binary()))]
            return pa.record_batch(cols, names=["shard", "block", "start", "doc_ids", "lengths", "bits", "payload"])

        for batch in batches:
            for i, s, d in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids")):
                d = d.as_buffer().to_pybytes()
                if ids and (s != shard or sum(lens) >= limit):
                    yield row()
                    block, start = (block + 1, start + sum(lens)) if s == shard else (0, 0)
                    ids, lens, data = [], [], []
                shard = s
                ids.append(i)
                lens.append(len(d) // int(small_id[2]))
                data.append(d)
        if ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every row of ``docs`` (doc_id, text) and writes the format above to ``path``.

    A null text is empty; ``end_id`` follows every document.  Shards are ranges of
    doc_id of about equal bytes, so only the ids (two bytes each for this vocabulary)
    are moved, once.  A null doc_id comes first; rows that repeat a doc_id are in
    order of a hash of their texts.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_TEXT))
    where = cuts(docs, min(wanted, n), n)
    bits = bits_for(Encoder(tokenizer).size)
    coded = docs.mapInArrow(_encode(tokenizer, spark.sparkContext.broadcast(where), end_id), "doc_id long, shard long, h long, ids binary")
    # one shard to a partition
    placed = coded.repartitionById(len(where.ids) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "h", "ids")
    packed = placed.mapInArrow(tidy(_blocks(bits, block_ids)), "shard long, block long, start long, doc_ids array<long>, lengths array<long>, bits int, payload binary")
    packed.write.mode("overwrite").option("compression", "none").parquet(path)


def _read(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            bits = batch.column("bits")[r].as_py()
            payload = batch.column("payload")[r].as_buffer().to_pybytes()
            lens = batch.column("lengths")[r].as_py()
            ids = unpack(payload, bits, 0, sum(lens)).astype("<u4")
            ends = np.cumsum(lens)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lens)]
            n = len(lens)
            yield pa.record_batch(
                [batch.column("doc_ids")[r].values, pa.array(np.full(n, batch.column("shard")[r].as_py(), np.int64)), pa.array(ends - np.array(lens, np.int64) + batch.column("start")[r].as_py(), pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
            )


def _shard_starts(files: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, ids before it, its ids) of all shards: a row for each ``SHARD_TEXT`` bytes of text."""
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    base, out = 0, []
    for r in sorted(files.groupBy("shard").agg(F.sum(n).alias("n")).collect()):
        out.append((r["shard"], base, r["n"]))
        base += r["n"]
    return out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, by document: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    files = spark.read.parquet(path)
    rows = [r[:2] for r in _shard_starts(files)]
    starts = spark.createDataFrame(rows, "shard long, base long")
    docs = files.mapInArrow(tidy(_read), "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")
    return docs.join(small(starts, len(rows)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, first: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids from global position ``first``; one job reads only the blocks that hold them."""
    files = spark.read.parquet(path)
    near = {s: base for s, base, n in _shard_starts(files) if base < first + count and base + n > first}
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    got = files.where(F.col("shard").isin(list(near))).select("shard", "start", n.alias("n"), "bits", "payload") if near else None
    if got is None or not count:
        return np.empty(0, np.uint32)
    bases = spark.createDataFrame(list(near.items()), "shard long, base long")
    got = got.join(small(bases, len(near)), "shard").withColumn("at", F.col("base") + F.col("start"))
    rows = got.where((F.col("at") < first + count) & (F.col("at") + F.col("n") > first)).select("at", "n", "bits", "payload").collect()
    return np.concatenate([unpack(bytes(r["payload"]), r["bits"], lo := max(0, first - r["at"]), min(r["n"], first + count - r["at"]) - lo) for r in sorted(rows, key=lambda r: r["at"])])


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder and returns the index read back from the files.

    One row per row of ``docs``; nulls, empty texts and repeats as in ``write_tokens``.
    """
    work = Work(docs.sparkSession, "tokens")
    write_tokens(docs, f"{work.path}/ids", tokenizer)
    return token_index(docs.sparkSession, f"{work.path}/ids")
