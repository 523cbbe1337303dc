"""Phrases whose words stand together more often than their parts would by chance.

Words that are frequent in their language get a number; all others, and the ends
of pieces, break the text.  A text is then a sequence of numbers, and a phrase of
``k`` words a binary key of ``k`` numbers of fixed width, most significant byte
first.  Counting is sorting: a task sorts the keys of a batch by a radix sort over
16-bit digits and counts runs, Spark deals (key, count) rows out by ranges of the
key and sorts each range, and runs of equal keys are summed as they stream by.

A phrase is frequent only if the two phrases within it that are one word shorter
are.  Before phrases of ``k`` words are counted, those whose parts are surely
rare are left out: the frequent keys of ``k - 1`` words set bits in a bitmap of a
fixed size, which is all that goes to the tasks.  A bit set by another key costs
a row and no error, as counts decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Work, buffer_of, lower, mix, shards, ship, span_hashes, tidy, words_of

#: Frequent words up to which their hashes and numbers go to the tasks by broadcast, 16 bytes each; beyond, words are numbered by a join.
DICTIONARY_WORDS = 1 << 20
#: Bits that tell which shorter phrases may be frequent.
BITMAP_BITS = 1 << 27
#: Parts by which a language's phrases are first cut to the wanted number.
SALTS = 32

#: Bytes of [^\x20\x09.,;:!?\x0A-\x0D], and those that end a piece.
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14), *b".,;:!?"]] = False
PIECE_END = np.zeros(256, np.uint8)
PIECE_END[[*range(10, 14), *b".,;:!?"]] = 1


# ---------------------------------------------------------------- words
def _language(names: list[str]) -> np.ndarray:
    """A hash of each language's name."""
    data, offsets = buffer_of(pa.array(names, pa.string()))
    return mix(span_hashes(data, offsets[:-1], offsets[1:]) + U64(1)) if len(names) else np.empty(0, U64)


def _scan(batch: pa.RecordBatch):
    """By shard of a batch (lang, text): lower-cased bytes, starts and ends of words, the first word of each row, hashes of (language, word), language by word."""
    coded = batch.column("lang").dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    salt = _language(names)
    data, offsets = buffer_of(batch.column("text"))
    for i, j in shards(offsets):
        low = lower(data[offsets[i] : offsets[j]])
        starts, ends, first = words_of(low, offsets[i : j + 1] - offsets[i], WORD)
        of = np.repeat(code[i:j], np.diff(first))
        with np.errstate(over="ignore"):
            h = mix(span_hashes(low, starts, ends) + salt[of]) if len(starts) else np.empty(0, U64)
        yield low, starts, ends, first, h, [names, of]


def _word_counts(batches):
    for batch in batches:
        found = []
        for low, starts, ends, _, h, (names, of) in _scan(batch):
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            found.append((u, n, of[at], [low[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
        if not found:
            continue
        h = np.concatenate([x[0] for x in found])
        u, at, where = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate([x[1] for x in found]), len(u)).astype(np.int64)
        lang = np.concatenate([x[2] for x in found])[at]
        words = [w for x in found for w in x[3]]
        yield pa.record_batch([pa.array(names, pa.string()).take(pa.array(lang)), pa.array([words[k] for k in at], pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "word", "f"])


def _word_hashes(batches):
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        salt = _language(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        data, offsets = buffer_of(batch.column("word"))
        out = []
        for i, j in shards(offsets):
            with np.errstate(over="ignore"):
                out.append(mix(span_hashes(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]) + salt[i:j]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), batch.column("id")], names=["h", "id"])


def _breaks(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece ends before each word."""
    upto = np.concatenate([[0], np.cumsum(PIECE_END[low], dtype=np.int64)])
    out = np.ones(len(starts), bool)
    out[1:] = upto[starts[1:]] > upto[ends[:-1]]
    out[first[:-1][first[:-1] < len(starts)]] = True
    return out


def _encode(sent):
    """Numbers of the words of a shard, 0 for rare words and before each piece."""

    def run(batches):
        known, number = sent.value
        for batch in batches:
            for low, starts, ends, first, h, _ in _scan(batch):
                if not len(h) or not len(known):
                    continue
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ids = np.where(known[k] == h, number[k], 0).astype(np.uint32)
                cut = _breaks(low, starts, ends, first)
                out = np.zeros(len(ids) + int(cut.sum()), np.uint32)
                out[np.arange(len(ids)) + np.cumsum(cut)] = ids
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["ids"])

    return tidy(run)


def _hash_lists(batches):
    """Hashes of the words of each row, with a 0 before each piece."""
    n = 0
    for batch in batches:
        part = batch.column("part").to_numpy()
        done = 0
        for low, starts, ends, first, h, _ in _scan(batch):
            cut = _breaks(low, starts, ends, first)
            at = np.arange(len(h)) + np.cumsum(cut)
            flat = np.zeros(len(h) + int(cut.sum()), np.int64)
            flat[at] = h.view(np.int64)
            ends_at = np.concatenate([first + np.concatenate([[0], np.cumsum(cut)])[first]])
            rows = len(first) - 1
            key = part[done : done + rows].astype(np.int64) << 40 | n + np.arange(rows)
            n, done = n + rows, done + rows
            yield pa.record_batch([pa.array(key), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(flat))], names=["key", "hashes"])


def _joined_ids(batches):
    for batch in batches:
        for ids in batch.column("ids"):
            yield pa.record_batch([pa.array([ids.values.to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()], pa.binary())], names=["ids"])


def numbered(rows: DataFrame, by: list[str], work: Work) -> DataFrame:
    """``rows`` with ``id`` from 1 on; ``by`` tells rows apart."""
    dealt = work.table(rows.repartition(*by).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return work.table(dealt.withColumn("_k", inner).join(starts, "_part").withColumn("id", (F.col("_base") + F.col("_k")).cast("long")).drop("_part", "_base", "_k"), "dictionary")


def encoded(docs: DataFrame, dictionary: DataFrame, words: int, work: Work, bound: int) -> DataFrame:
    """``docs`` (lang, text) as rows of numbers."""
    hashes = dictionary.select("lang", "word", "id").mapInArrow(tidy(_word_hashes), "h long, id long")
    if words <= bound:
        got = hashes.toArrow()
        h, number = got.column("h").to_numpy().view(U64), got.column("id").to_numpy().astype(np.uint32)
        order = np.argsort(h)
        sent = docs.sparkSession.sparkContext.broadcast((h[order], number[order]))
        return work.table(docs.mapInArrow(_encode(sent), "ids binary"), "coded")
    lists = docs.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(_hash_lists), "key long, hashes array<long>")
    flat = work.table(lists.select("key", F.posexplode("hashes").alias("at", "h")), "words")
    named = flat.join(hashes, "h", "left").select("key", F.struct("at", F.coalesce("id", F.lit(0)).alias("id")).alias("w"))
    ids = named.groupBy("key").agg(F.array_sort(F.collect_list("w")).alias("w")).select(F.col("w.id").alias("ids"))
    return work.table(ids.mapInArrow(tidy(_joined_ids), "ids binary"), "coded")


# ---------------------------------------------------------------- keys
def width_of(words: int) -> int:
    """Bytes of a number up to ``words``."""
    return 2 if words < 1 << 16 else 3 if words < 1 << 24 else 4


def pack(ids: list[np.ndarray], width: int) -> pa.Array:
    """Columns of numbers as fixed-width keys."""
    out = np.empty((len(ids[0]), len(ids) * width), np.uint8)
    for j, x in enumerate(ids):
        for b in range(width):
            out[:, j * width + b] = x >> (8 * (width - 1 - b)) & 255
    offsets = np.arange(len(out) + 1, dtype=np.int32) * (len(ids) * width)
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(keys: pa.Array, width: int) -> list[np.ndarray]:
    data, _ = buffer_of(keys)
    if not len(keys):
        return []
    data = data.reshape(len(keys), -1)
    out = []
    for j in range(data.shape[1] // width):
        x = np.zeros(len(keys), np.uint32)
        for b in range(width):
            x = x << np.uint32(8) | data[:, j * width + b]
        out.append(x)
    return out


def radix_order(ids: list[np.ndarray], width: int) -> np.ndarray:
    """Order of packed keys, by digits of 16 bits from the last on."""
    order = None
    for x in reversed(ids):
        for shift in range(0, 8 * width, 16):
            digit = (x >> np.uint32(shift) & np.uint32(0xFFFF)).astype(np.uint16)
            turn = np.argsort(digit if order is None else digit[order], kind="stable")
            order = turn if order is None else order[turn]
    return order


def _bits(ids: list[np.ndarray]) -> np.ndarray:
    """The bit of each phrase."""
    h = np.zeros(len(ids[0]), U64)
    with np.errstate(over="ignore"):
        for x in ids:
            h = mix(h * U64(0x9E3779B97F4A7C15) + x.astype(U64) + U64(1))
    return (h & U64(BITMAP_BITS - 1)).astype(np.int64)


def _phrase_counts(size: int, width: int, sent):
    """(key, n) of the phrases of ``size`` words of a batch of coded rows."""

    def run(batches):
        bitmap = sent.value if sent is not None else None
        for batch in batches:
            data, _ = buffer_of(batch.column("ids"))
            seq = np.concatenate([np.frombuffer(data.tobytes(), np.uint32), np.zeros(size, np.uint32)])
            fits = seq[: -size + 1] != 0
            for j in range(1, size):
                fits &= seq[j : len(fits) + j] != 0
            at = np.flatnonzero(fits)
            if bitmap is not None and len(at):
                # the bit of the part at each place, looked up where a phrase needs it
                need = np.unique(np.concatenate([at, at + 1]))
                bit = _bits([seq[need + j] for j in range(size - 1)])
                good = np.zeros(len(seq), bool)
                good[need[bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]] = True
                at = at[good[at] & good[at + 1]]
            if not len(at):
                continue
            ids = [seq[at + j] for j in range(size)]
            order = radix_order(ids, width)
            ids = [x[order] for x in ids]
            new = np.ones(len(at), bool)
            new[1:] = False
            for x in ids:
                new[1:] |= x[1:] != x[:-1]
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(at)))
            for k in range(0, len(heads), 1 << 16):
                part = heads[k : k + (1 << 16)]
                yield pa.record_batch([pack([x[part] for x in ids], width), pa.array(n[k : k + (1 << 16)], pa.int64())], names=["key", "n"])

    return tidy(run)


def _run_lengths(least: int):
    """Sums of runs of equal keys in sorted rows, those of ``least`` or more."""

    def run(batches):
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("key"), batch.column("n").to_numpy()
            data, offsets = buffer_of(keys)
            rows = data.reshape(len(keys), -1)
            heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
            sums = np.add.reduceat(n, heads)
            names = [rows[heads[0]].tobytes(), rows[heads[-1]].tobytes()]
            if last == names[0]:
                sums[0] += held
                last = None
            out, counts = [], []
            if last is not None and held >= least:
                out.append(pa.array([last], pa.binary()))
                counts.append([held])
            done = np.flatnonzero(sums[:-1] >= least)
            out.append(keys.take(pa.array(heads[done])))
            counts.append(sums[done])
            last, held = names[1], int(sums[-1])
            yield pa.record_batch([pa.concat_arrays(out), pa.array(np.concatenate(counts).astype(np.int64))], names=["key", "a"])
        if last is not None and held >= least:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([held], pa.int64())], names=["key", "a"])

    return tidy(run)


def _bit_rows(width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(_bits(unpack(batch.column("key"), width)))], names=["bit"])

    return tidy(run)


def _bitmap(frequent: DataFrame, width: int) -> np.ndarray:
    """Bits of the frequent phrases: blocks of 4 KB, ``BITMAP_BITS`` in all at most."""
    rows = frequent.select("key").mapInArrow(_bit_rows(width), "bit long").groupBy(F.expr("bit div 32768").alias("block"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows.agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


# ---------------------------------------------------------------- the whole
def frequent_phrases(coded: DataFrame, longest: int, least: int, width: int, work: Work) -> list[DataFrame]:
    """(key, a) of the phrases of 2 to ``longest`` words, by number of words."""
    out: list[DataFrame] = []
    sent = None
    for size in range(2, longest + 1):
        rows = coded.mapInArrow(_phrase_counts(size, width, sent), "key binary, n long")
        ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
        out.append(work.table(ordered.mapInArrow(_run_lengths(least), "key binary, a long"), f"phrases{size}"))
        if size < longest:
            sent = coded.sparkSession.sparkContext.broadcast(_bitmap(out[-1], width))
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, bound: int = DICTIONARY_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Of ``docs`` (lang, text).  A null text has no words, a null language is
    ``und``; rows that repeat count as often; equal scores are ordered by ``a`` and
    the phrase; a table without words, or without a phrase that comes ``least``
    times, gives no rows.  Other columns are ignored.  ``n`` counts a language's
    words, ``a``, ``l`` and ``r`` a phrase and the parts of its weakest cut.  A
    phrase goes if one word more keeps ``share`` hundredths of its count: phrases
    longer by two words are counted no more often than one between.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "collocations")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(tidy(_word_counts), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = work.table(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary = numbered(counts.where(F.col("f") >= least), ["lang", "word"], work)
    words = dictionary.count()
    width = width_of(words)
    coded = encoded(texts, dictionary, words, work, bound)
    found = frequent_phrases(coded, longest, least, width, work)
    phrases = found[0]
    for part in found[1:]:
        phrases = phrases.unionByName(part)
    number = F.substring(F.to_binary(F.lpad(F.hex("id"), 2 * width, "0"), F.lit("hex")), 1, width)
    single = dictionary.join(totals, "lang").select(number.alias("key"), F.col("f").alias("a"), "lang", "n", "word")
    single = work.table(single, "single")
    parts = single.select("key", "a", "lang", "n").unionByName(phrases, allowMissingColumns=True)
    size = F.octet_length("key") / width
    # a phrase inside a longer one that is as frequent
    longer = phrases.where(size > 2).select("a", F.explode(F.array(F.expr(f"substring(key, 1, octet_length(key) - {width})"), F.expr(f"substring(key, {width + 1})"))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("up"))
    own = phrases.join(longer, "key", "left").where(F.col("up").isNull() | (100 * F.col("up") < share * F.col("a"))).select("key", "a")
    cuts = own.select(F.col("key").alias("whole"), "a", F.explode(F.sequence(F.lit(1), size.cast("int") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr(f"substring(whole, 1, k * {width})")).withColumn("right", F.expr(f"substring(whole, k * {width} + 1)"))
    cuts = cuts.join(parts.select(F.col("key").alias("left"), F.col("a").alias("l"), "lang", "n"), "left")
    cuts = cuts.join(parts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    # the first cut's left part is a word, which knows its language
    each = cuts.groupBy(F.col("whole").alias("key"), "a").agg(F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    exact = "cast((cast(1000 as decimal(38, 0)) * a * n) div (cast(c.l as decimal(38, 0)) * c.r) as bigint)"
    scored = each.select("key", "lang", "a", "n", F.expr(f"array_min(transform(cuts, c -> struct({exact} as score, c.k as k, c.l as l, c.r as r)))").alias("least"))
    scored = scored.select("key", "lang", "a", "n", "least.score", "least.l", "least.r")
    # ties stay in until the phrases can be read
    best = [F.desc("score"), F.desc("a")]
    some = scored.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    some = some.withColumn("_at", F.rank().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("_at") <= top).drop("_salt")
    some = work.table(some.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("_at") <= top).drop("_at"), "best")
    spelled = some.select("key", F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("j")).withColumn("one", F.expr(f"substring(key, j * {width} + 1, {width})"))
    spelled = spelled.join(single.select(F.col("key").alias("one"), "word"), "one").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "word"))).alias("w"))
    named = some.join(spelled, "key").withColumn("phrase", F.array_join(F.col("w.word"), " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
