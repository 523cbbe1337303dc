"""Alignment of two tokenizers' tokens by the bytes they stand for.

A whole Arrow batch is one string of bytes, document after document.  The ends
of all A tokens, and of all B tokens, are counted by byte offset once; where both
counts are positive the tokens are cut into groups, and an A and a B token that
end there are linked.  Sums by document are differences of running sums.

The id pairs of all links are counted over the corpus in a second pass over the
written links, and each document is judged by those counts in a third.  Pairs
that are counted most go to the tasks by broadcast, up to a fixed number; links
of the others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARD_BYTES, Work, buffer_of, shards, ship, tidy
from .tokens import CACHE_BYTES, LONG, OVERHEAD, Encoder, default_tokenizer

#: Pairs that go to the tasks by broadcast, 16 bytes each.
BROADCAST_PAIRS = 1 << 21


def default_pieces() -> str:
    """The public sentence-piece model that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Table:
    """Bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids in turn."""
        size = self.size[ids]
        total = int(size.sum())
        shift = self.at[ids] - (np.cumsum(size) - size)
        return self.data[np.arange(total) + np.repeat(shift, size)]


def _byte_level() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteTokens(Encoder):
    """A: a byte-level vocabulary; special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        code = _byte_level()
        special = set(self.special)
        names = [self.tok.id_to_token(i) or "" for i in range(self.size)]
        self.table = Table([n.encode() if n in special else bytes(code.get(c, 63) for c in n) for n in names])


class PieceTokens:
    """B: a sentence-piece model, which adds a space in front.

    No piece of such a vocabulary has a space behind another character, so a text
    falls into words with the spaces before them, each encoded by itself and looked
    up if it came before.  Any other model encodes whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(size)]
        self.table = Table([bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.wordwise = not any("▁" in n.lstrip("▁") for n in names) and self._plain(path)
        blank = m.piece_to_id("▁")
        self.known: dict[str, bytes] = {}
        self.fixed = {"": np.array([blank], "<u4").tobytes()} if names[blank] == "▁" else {}
        self.wordwise = self.wordwise and bool(self.fixed)
        self.held = 0

    @staticmethod
    def _plain(path: str) -> bool:
        """Whether the model leaves a text as it is."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:
            return False
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        return n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each; an empty text has none."""
        if not self.wordwise:
            return self.whole(texts)
        # what follows a word's first space; a space that ends a text, or stands between spaces, is part of the run
        words = [[t] if "▁" in t else _WORDS.findall(t) for t in texts]  # the model takes that character for a space
        new = sorted({w for ws in words for w in ws if w not in self.known and w not in self.fixed})
        got = dict(zip(new, self.whole(new)))
        look = self.fixed | got
        keep = {w: x for w, x in got.items() if len(w) <= LONG}
        cost = sum(map(len, keep)) + sum(map(len, keep.values())) + OVERHEAD * len(keep)
        known = self.known
        out = [b"".join([known[w] if w in known else look[w] for w in ws]) if t else b"" for t, ws in zip(texts, words)]
        if self.held + cost > CACHE_BYTES:
            known.clear()
            self.held = 0
        if cost <= CACHE_BYTES:
            known.update(keep)
            self.held += cost
        return out


#: Of a text: each word with the spaces before it, but without the first of them, which the model adds.
_WORDS = re.compile(r"(?:^|(?<=[^ ]) )( *[^ ]*)")
_CODERS: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}


def coders(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    """The coders of this Python worker; what they remember serves later tasks too."""
    if (a, b) not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CODERS.clear()
        _CODERS[a, b] = ByteTokens(a), PieceTokens(b)
    return _CODERS[a, b]


# ---------------------------------------------------------------- a batch
def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a column between the given bounds."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[first[1:]] - upto[first[:-1]]


def _same_text(table: Table, ids: np.ndarray, first: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents' tokens join to their bytes."""
    size = np.diff(offsets)
    good = _sums(table.size[ids], first) == size
    some = np.repeat(good, np.diff(first))
    differ = table.joined(ids[some]) != text[np.repeat(good, size)]
    bounds = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
    return good & (_sums(differ, bounds) == 0)


def align(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, a_table: Table, b_table: Table):
    """Tokens of many documents whose bytes agree: group of each A and B token, and the positions of the linked ones.

    Every token has a byte or more, so one A and one B token at most end at an offset.
    """
    a_end, b_end = np.cumsum(a_table.size[a]), np.cumsum(b_table.size[b])
    n = int(a_end[-1]) + 1 if len(a) else 1
    cut = (np.bincount(a_end, minlength=n) > 0) & (np.bincount(b_end, minlength=n) > 0)
    groups = np.cumsum(cut) - cut  # cuts before an offset
    return groups[a_end], groups[b_end], np.flatnonzero(cut[a_end]), np.flatnonzero(cut[b_end])


def spelled(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups as text, ``a1,a2|b1;...`` each ended by a semicolon; and where each A token and each B token starts."""
    total = len(a) + len(b)
    a_upto, b_upto = np.searchsorted(a_group, b_group, side="right"), np.searchsorted(b_group, a_group, side="left")
    a_at, b_at = np.arange(len(a)) + b_upto, np.arange(len(b)) + a_upto
    ids = np.empty(total, np.int64)
    ids[a_at], ids[b_at] = a, b
    sign = np.full(total, ord(","), np.uint8)
    sign[a_at[np.append(a_group[1:] != a_group[:-1], True)[: len(a)]]] = ord("|")
    sign[b_at[np.append(b_group[1:] != b_group[:-1], True)[: len(b)]]] = ord(";")
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000) + (ids >= 100_000)
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if total else 0, np.uint8)
    out[ends - 1] = sign
    rest = ids
    for k in range(int(digits.max()) if total else 0):
        mine = digits > k
        out[ends[mine] - 2 - k] = 48 + rest[mine] % 10
        rest = rest // 10
    starts = ends - digits - 1
    return out, starts[a_at], starts[b_at]


def _links(a_path: str, b_path: str, groups: bool):
    def run(batches):
        one, two = coders(a_path, b_path)
        for whole in batches:
            _, bounds = buffer_of(whole.column("text"))
            for i, j in shards(bounds, SHARD_BYTES // 2):
                batch = whole.slice(i, j - i)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                spaced = [" " + t if t else "" for t in texts]
                data, offsets = buffer_of(pa.array(spaced, pa.large_string()))
                raw_a, raw_b = one.encode(spaced), two.encode(texts)
                a, b = np.frombuffer(b"".join(raw_a), one.kind).astype(np.int64), np.frombuffer(b"".join(raw_b), "<u4").astype(np.int64)
                width = np.dtype(one.kind).itemsize
                a_first = np.concatenate([[0], np.cumsum([len(x) // width for x in raw_a])]).astype(np.int64)
                b_first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw_b])]).astype(np.int64)
                good = _same_text(one.table, a, a_first, data, offsets) & _same_text(two.table, b, b_first, data, offsets)
                a, b = a[np.repeat(good, np.diff(a_first))], b[np.repeat(good, np.diff(b_first))]
                n_a, n_b = np.where(good, np.diff(a_first), 0), np.where(good, np.diff(b_first), 0)
                a_first, b_first = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
                a_group, b_group, x, y = align(a, a_first, b, b_first, one.table, two.table)
                linked = np.zeros(len(a), bool)
                linked[x] = True
                n = _sums(linked, a_first)
                pairs = (a[x] << 32 | b[y]).astype("<i8")
                cut = np.concatenate([[0], np.cumsum(n)])
                out, at, _ = spelled(a, a_group, b, b_group)
                at = np.append(at, len(out))[a_first]
                text = memoryview(out.tobytes())
                # without the last semicolon
                said = [bytes(text[p : q - 1]) if q > p else b"" for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = {
                    "doc_id": batch.column("doc_id"), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "n_groups": pa.array(n, pa.int64()), "n_links": pa.array(n, pa.int64()),
                    "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in said]), "links": pa.array([pairs[p:q].tobytes() for p, q in zip(cut[:-1], cut[1:])], pa.binary()),
                }
                if groups:
                    cols["groups"] = pa.array(said, pa.binary()).cast(pa.string())
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return tidy(run)


def _count_pairs(batches):
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        for i, j in shards(offsets, 8 << 20):
            pair, n = np.unique(np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<i8"), return_counts=True)
            yield pa.record_batch([pa.array(pair), pa.array(n, pa.int64())], names=["pair", "n"])


def _judge(sent, rest: bool):
    """Adds n_best and count_sum over the links whose pair is known; the others are listed with their number."""

    def run(batches):
        known, count, best = sent.value
        for batch in batches:
            data, offsets = buffer_of(batch.column("links"))
            for i, j in shards(offsets, 8 << 20):
                pair = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<i8")
                first = (offsets[i : j + 1] - offsets[i]) // 8
                k = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                hit = known[k] == pair if len(known) else np.zeros(len(pair), bool)
                part = batch.slice(i, j - i)
                names = [c for c in batch.schema.names if c != "links"]
                got = np.where(hit, count[k], 0) if len(known) else np.zeros(len(pair), np.int64)
                cols = [part.column(c) for c in names] + [pa.array(_sums(hit & best[k] if len(known) else hit, first)), pa.array(_sums(got, first))]
                names += ["n_best", "count_sum"]
                if rest:
                    cut = np.concatenate([[0], np.cumsum(_sums(~hit, first))])
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pair[~hit], pa.int64())))
                    names.append("rest")
                yield pa.record_batch(cols, names=names)

    return tidy(run)


def pair_counts(links: DataFrame, work: Work) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no other pair of its B id has more; pair = a << 32 | b."""
    counts = links.select("links").mapInArrow(tidy(_count_pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = work.table(counts, "counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary
    return work.table(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, groups: bool = False, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``groups`` adds the groups themselves, as text.  A null or empty text, and one
    that a tokenizer does not give back byte for byte, has no tokens: zeros, and an
    empty hash.  Rows that repeat are returned, and their links counted, as often;
    a null doc_id is kept; pairs with equal counts of one B id are all its best; an
    empty table gives none.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cols = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    extra = ", groups string" * groups
    links = rows.mapInArrow(_links(a or default_tokenizer(), b or default_pieces(), groups), f"{cols}, links binary{extra}")
    links = work.table(links.withColumn("_row", F.monotonically_increasing_id()), "links")
    pairs = pair_counts(links, work)
    total = pairs.count()
    heavy = pairs
    if total > bound:
        # the counts by size, from the largest down: the least count of which all pairs fit
        sizes = pairs.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(bound).toPandas()
        fits = int((sizes["c"].cumsum() <= bound).sum())
        heavy = pairs.where(F.col("n") >= int(sizes["n"][fits - 1])) if fits else pairs.limit(0)
    got = heavy.toArrow()
    pair = got.column("pair").to_numpy()
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order], got.column("n").to_numpy()[order], got.column("best").to_numpy(zero_copy_only=False)[order]))
    cols = f"{cols}{extra}, _row long, n_best long, count_sum long"
    out = links.mapInArrow(_judge(sent, total > bound), cols + ", rest array<long>" * (total > bound))
    if total > bound:
        out = work.table(out, "judged")
        light = out.select("_row", F.explode("rest").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("k"))
        sums = light.join(pairs, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("b"), F.sum(F.col("k") * F.col("n")).alias("s"))
        more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        out = out.join(sums, "_row", "left").select(*[c for c in out.columns if c not in ("n_best", "count_sum", "rest")], more("n_best", "b"), more("count_sum", "s"))
    named = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*named, *["groups"] * groups)
