"""Benchmark decontamination with suffix arrays over training shards.

A task turns its documents, shard by shard, into one array of word numbers (the
words of the benchmark are numbered, all others are 0, and 0 also ends each
document) and sorts the suffixes of that array to the depth of a window.  Every
suffix of every test item is looked up by binary search; the range found lists
all its places.  Windows that follow one another on a diagonal are joined to the
longest verbatim matches.  A document never leaves its task, so nothing is
shuffled; the test items are the stated query set and go to the tasks by
broadcast up to a counted bound, in blocks beyond it.

Equal windows are one window, whatever items hold it, and windows of the same
items share one list of them, so a passage that thousands of items or places
repeat costs its places once, not their product.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Work, buffer_of, lower, mix, shards, ship, span_hashes, tidy, words_of

#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Pairs of a place and a window of an item that are looked at together.
PAIRS = 1 << 20


class TestItems:
    """Windows of a block of test items, as word numbers."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window = window
        self.ids = ["" if i is None else str(i) for i in ids]
        data, offsets = buffer_of(pa.array(texts, pa.large_string()))
        low = lower(data)
        starts, ends, first = words_of(low, offsets, ALNUM)
        h = span_hashes(low, starts, ends)
        self.vocabulary = np.unique(h)
        number = np.searchsorted(self.vocabulary, h).astype(U64) + U64(1)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = max(1, 64 // self.bits)
        self.levels = -(-window // self.per)
        n = np.diff(first)
        self.word_start = first
        self.words = np.concatenate([number, np.zeros(self.levels * self.per, U64)])
        count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        item = np.repeat(np.arange(len(n)), count)
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, size = first[:-1][item] + off, np.minimum(n[item], window)
        # equal windows become one: (level keys, size) name a window
        self.at, self.size = at, size
        names = [size, *(self.bounds(level)[0] for level in range(self.levels))]
        order = np.lexsort(names)
        new = np.ones(len(order), bool)
        for x in names:
            if len(x):
                new[1:] &= x[order][1:] == x[order][:-1]
        if len(new):
            new[1:] = ~new[1:]
        self.at, self.size = at[order[new]], size[order[new]]
        # the places of each window: (item, offset) from place_from[w] to place_from[w + 1]
        self.place_item, self.place_off = item[order], off[order]
        self.place_from = np.append(np.flatnonzero(new), len(order))
        # windows of the same items share one list of items
        holder = np.repeat(np.arange(len(self.at)), np.diff(self.place_from))
        pairs = np.unique(holder * max(1, len(n)) + self.place_item)
        holder, held = pairs // max(1, len(n)), pairs % max(1, len(n))
        cut = np.searchsorted(holder, np.arange(len(self.at) + 1))
        sums = np.empty(0, U64)
        if len(self.at):
            with np.errstate(over="ignore"):
                sums = mix(np.add.reduceat(mix(held.astype(U64) + U64(1)), cut[:-1]) + np.diff(cut).astype(U64))
        _, head, self.list_of = np.unique(sums, return_index=True, return_inverse=True)
        self.lists = [held[cut[w] : cut[w + 1]] for w in head]

    def items_by_row(self, r: np.ndarray, which: np.ndarray) -> dict[int, list[str]]:
        """For each row that holds a window, the ids of all items with one, sorted."""
        out: dict[int, list[str]] = {}
        if len(r):
            pair = np.unique(r * len(self.lists) + self.list_of[which])
            row, part = pair // len(self.lists), pair % len(self.lists)
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(pair))):
                found: set[int] = set()
                for k in part[a:b]:
                    found.update(self.lists[k].tolist())
                out[int(row[a])] = sorted({self.ids[k] for k in found})
        return out

    def bounds(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest and largest packed key of each window at this level; and whether the window reaches it."""
        low = np.zeros(len(self.at), U64)
        high = np.zeros(len(self.at), U64)
        for k in range(self.per):
            inside = self.size > level * self.per + k
            w = self.words[self.at + level * self.per + k]
            low = (low << U64(self.bits)) | np.where(inside, w, U64(0))
            high = (high << U64(self.bits)) | np.where(inside, w, U64((1 << self.bits) - 1))
        return low, high, self.size > level * self.per


class SuffixArray:
    """Suffixes of a shard that begin with a word of the test items, sorted to the depth of a window."""

    def __init__(self, numbers: np.ndarray, items: TestItems):
        self.items = items
        n, per, bits = len(numbers), items.per, U64(items.bits)
        padded = np.concatenate([numbers, np.zeros(items.levels * per, U64)])
        packed = np.zeros(n + (items.levels - 1) * per, U64)
        for k in range(per):
            packed = (packed << bits) | padded[k : k + len(packed)]
        at = np.flatnonzero(numbers)
        order = np.argsort(packed[at])
        at = at[order]
        key = packed[at]
        if len(at) > 1 and items.levels > 1:
            same = np.zeros(len(at), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            tied = np.flatnonzero(same)
            if len(tied):
                sub = at[tied]
                deep = [packed[sub + level * per] for level in range(items.levels - 1, 0, -1)]
                at[tied] = sub[np.lexsort([*deep, packed[sub]])]
        self.at = at
        self.keys = [packed[at + level * per] for level in range(items.levels)]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of suffixes that begin with it, by binary search level by level."""
        low, high, _ = self.items.bounds(0)
        lo = np.searchsorted(self.keys[0], low, side="left")
        hi = np.searchsorted(self.keys[0], high, side="right")
        for level in range(1, self.items.levels):
            low, high, live = self.items.bounds(level)
            q = np.flatnonzero((hi > lo) & live)
            a = _bisect(self.keys[level], lo[q], hi[q], low[q], False)
            b = _bisect(self.keys[level], lo[q], hi[q], high[q], True)
            lo[q], hi[q] = a, b
        return lo, np.maximum(lo, hi)


def _bisect(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of many values at once, each in its own range of ``keys``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        right = keys[mid] <= want[open_] if after else keys[mid] < want[open_]
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)


def occurrences(low: np.ndarray, offsets: np.ndarray, items: TestItems):
    """(n_words by row, row, word position, window) of every place of every different window in these rows.

    At one place begin one window of full length and those of shorter items at
    most, so the result has fewer than ``window`` rows to a word.
    """
    starts, ends, first = words_of(low, offsets, ALNUM)
    n = np.diff(first)
    none = np.empty(0, np.int64)
    if not len(starts) or not len(items.at):
        return n, none, none, none
    h = span_hashes(low, starts, ends)
    k = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    number = np.where(items.vocabulary[k] == h, k + 1, 0).astype(U64)
    row = np.repeat(np.arange(len(n)), n)
    numbers = np.zeros(len(h) + len(n), U64)
    numbers[np.arange(len(h)) + row] = number
    array = SuffixArray(numbers, items)
    lo, hi = array.ranges()
    found = np.flatnonzero(hi > lo)
    size = (hi - lo)[found]
    which = np.repeat(found, size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = array.at[lo[which] + inside]
    begin = first[:-1] + np.arange(len(n))
    r = np.searchsorted(begin, place, side="right") - 1
    return n, r, place - begin[r], which


def longest(low: np.ndarray, offsets: np.ndarray, items: TestItems):
    """Maximal matches of these rows, joined on diagonals: row, item, start in document, start in item, words; in parts.

    A match begins where the words before it differ; only those places are kept
    and followed on, word by word, so memory is bounded by ``PAIRS`` and the output.
    """
    n, r, pos, which = occurrences(low, offsets, items)
    starts, ends, first = words_of(low, offsets, ALNUM)
    h = span_hashes(low, starts, ends)
    k = np.minimum(np.searchsorted(items.vocabulary, h), max(0, len(items.vocabulary) - 1))
    number = np.append(np.where(items.vocabulary[k] == h, k + 1, 0).astype(U64), U64(0)) if len(items.vocabulary) else np.zeros(len(h) + 1, U64)
    size = np.diff(items.place_from)[which]
    upto = np.cumsum(size)
    a = 0
    while a < len(which):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        m = size[a:b]
        place = np.repeat(items.place_from[:-1][which[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        row, at, item, off = np.repeat(r[a:b], m), np.repeat(pos[a:b], m), items.place_item[place], items.place_off[place]
        d, t = first[row] + at, items.word_start[item] + off
        head = (at == 0) | (off == 0)
        head[~head] = number[d[~head] - 1] != items.words[t[~head] - 1]
        row, at, item, off, d, t = (x[head] for x in (row, at, item, off, d, t))
        long = np.repeat(items.size[which[a:b]], m)[head]
        room = np.minimum(n[row] - at, items.word_start[item + 1] - t)
        live = np.flatnonzero(long < room)
        while len(live):
            live = live[number[d[live] + long[live]] == items.words[t[live] + long[live]]]
            long[live] += 1
            live = live[long[live] < room[live]]
        yield row, item, at, off, long
        a = b


def _hits(n: np.ndarray, r: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By word of all rows, whether a window covers it."""
    first = np.concatenate([[0], np.cumsum(n)])
    change = np.bincount(first[r] + pos, minlength=first[-1] + 1) - np.bincount(first[r] + pos + size, minlength=first[-1] + 1)
    return np.cumsum(change)[:-1] > 0


def _scan(sent, finish: bool):
    """Adds a block's hits (packed bits) and item ids to each row."""

    def run(batches):
        items: TestItems = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffer_of(batch.column("text"))
            before, known = batch.column("hits"), batch.column("items")
            for i, j in shards(offsets):
                n, r, pos, which = occurrences(lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], items)
                hit = _hits(n, r, pos, items.size[which])
                first = np.concatenate([[0], np.cumsum(n)])
                mine = items.items_by_row(r, which)
                touched = np.add.reduceat(np.append(hit, False), np.minimum(first[:-1], len(hit)), dtype=np.int64) * (n > 0) if len(n) else n
                bits, names = [], []
                for k in range(j - i):
                    old = before[i + k].as_py()
                    if not touched[k] and not old:
                        bits.append(b"")
                        names.append(known[i + k].as_py() or [])
                        continue
                    mine_bits = np.packbits(hit[first[k] : first[k + 1]])
                    bits.append((mine_bits | np.frombuffer(old, np.uint8) if old else mine_bits).tobytes())
                    names.append(sorted({*mine.get(k, ()), *(known[i + k].as_py() or ())}))
                out = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(bits, pa.binary()), "items": pa.array(names, pa.list_(pa.string()))}
                if finish:
                    del out["hits"], out["items"]
                    out["n_hit"] = pa.array([int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits], pa.int64())
                    out["n_items"] = pa.array([len(x) for x in names], pa.int64())
                    out["items_sha256"] = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names])
                    out["items"] = pa.array(names, pa.list_(pa.string()))
                keep = [c for c in batch.schema.names if c not in ("n_words", "hits", "items") and not (finish and c == "text")]
                yield pa.record_batch([batch.column(c).slice(i, j - i) for c in keep] + list(out.values()), names=keep + list(out))

    return tidy(run)


def _blocks(benchmark: DataFrame, window: int):
    """The test items in blocks of a bounded size, one after another."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // BLOCK_BYTES) or 1
    for k in range(parts):
        part = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in part.where("text is not null").select("item_id", "text").collect() if r["item_id"] is not None)
        rows += sorted((None, r["text"]) for r in part.where("text is not null and item_id is null").collect())
        yield k == parts - 1, TestItems([r[0] for r in rows], [r[1] for r in rows], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated.

    A null text has no words; an item without words has no window; rows that
    repeat are returned as often; items that repeat an id count once; an item
    whose id is null is listed as an empty string.  An empty benchmark marks
    nothing.  Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    state = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("hits"), F.lit(None).cast("array<string>").alias("items")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    work = None
    for last, block in _blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(block)
        cols = f"doc_id {kind}" + ("" if last else ", text string") + ", n_words long"
        cols += ", n_hit long, n_items long, items_sha256 string, items array<string>" if last else ", hits binary, items array<string>"
        state = state.mapInArrow(_scan(sent, last), cols)
        if not last:
            work = work or Work(spark, "decontaminate")
            state = work.table(state, "block")
    return state.withColumn("contaminated", F.col("n_hit") > 0)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The longest verbatim matches: doc_id, item_id, doc_start, item_start, n_words (positions in words).

    Rows without words, items without words and an empty benchmark give none;
    rows and items that repeat are matched as often; an item whose id is null is
    named by an empty string.  Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for _, block in _blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, offsets = buffer_of(batch.column(1))
                for i, j in shards(offsets):
                    low = lower(data[offsets[i] : offsets[j]])
                    for row, item, a, b, n in longest(low, offsets[i : j + 1] - offsets[i], items):
                        names = pa.array([items.ids[k] for k in item], pa.string())
                        yield pa.record_batch([batch.column(0).take(pa.array(row + i)), names, pa.array(a), pa.array(b), pa.array(n)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, item_id string, doc_start long, item_start long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def _clean(sent):
    def run(batches):
        items = sent.value
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for i, j in shards(offsets):
                n, r, _, _ = occurrences(lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], items)
                keep = np.ones(len(n), bool)
                keep[r] = False
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return tidy(run)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` in its own columns without the rows that hold a window of a test item.

    Rows without words stay, and so do all rows with an empty benchmark; rows that
    repeat are decided alike.  Each block of test items filters what the one before
    left, in the same pass.
    """
    ship(docs.sparkSession)
    for _, block in _blocks(benchmark, window):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
