"""Verbatim repeats: every byte covered by a string of ``length`` bytes that also starts anywhere else.

Equal strings have to meet in one task, though the corpus fits none.  Every
string of ``length`` bytes holds a core of ``core`` bytes with the smallest hash
(the leftmost of equal ones), so equal strings have equal cores.  A segment is a
run of strings with one core.  The steps:

1. the cores of all documents are counted; only segments whose core occurs
   again go on, and equal segments become one with a weight;
2. the segments of a core are gathered in shards of bounded bytes.  A core with
   more segments than a shard holds (a passage with thousands of different
   surroundings) is split: its strings are dealt anew by where the core stands in
   them, with a longer common part as key, until a group fits; at last a group is
   one string;
3. each shard gets a suffix array to the depth of a string and its
   Burrows-Wheeler transform.  Breadth-first backward extension of intervals then
   finds the common prefixes of neighbouring suffixes by increasing value and
   stops at ``length``: what is still open there are the repeated strings;
4. the runs of repeated strings go back to the places of their segments and are
   merged by document.

Only rows with a text that holds a repeated core are read again, and texts are
moved twice: once to cut segments, once to remove bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, Work, _power_tables, buffer_of, mix, shards, ship, tidy

LENGTH = 200
CORE = 48
#: Bytes of text whose cores are searched together.
CHUNK = 1 << 18
#: Bytes of segments in a suffix array, about, and of the segments of one core beyond which it is split.
INDEX_BYTES = 1 << 20
GROUP_BYTES = 512 << 10
#: Ends a segment; no byte of UTF-8 text.
END = 255


# ---------------------------------------------------------------- segments
class Hasher:
    """Hashes of any span of a piece of text of up to a MB, after one pass."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inverse = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * p[:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """The hash of each span of ``width`` bytes."""
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, core: int):
    """Segments of the rows of a piece of text: row, start in the piece, strings, bytes before the core, core hash, segment hash."""
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    hasher = Hasher(data)
    at = hasher.every(core)
    # the hash in the upper bits, the position below: equal hashes go to the left
    low = U64((1 << max(1, int(n).bit_length())) - 1)
    least = (at & ~low) | np.arange(len(at), dtype=U64)
    span, width = 1, length - core + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n - length + 1], least[width - span :])
    where = (least & low).astype(np.int32)
    inside = np.zeros(len(where) + 1, np.int32)
    size = np.diff(offsets)
    full = size >= length
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    change = np.ones(len(where), bool)
    change[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(change & inside)
    change[:-1] = (where[1:] != where[:-1]) | ~inside[1:]
    change[-1] = True
    ends = np.flatnonzero(change & inside) + 1
    m = where[starts].astype(np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, starts, ends - starts, m - starts, at[m], hasher.spans(starts, ends - 1 + length)


def pieces(offsets: np.ndarray, length: int):
    """Ranges of rows, and of bytes in them, of about ``CHUNK`` bytes; a longer row goes in pieces that share ``length - 1`` bytes."""
    for i, j in shards(offsets, CHUNK):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= CHUNK:
            yield i, a, offsets[i : j + 1] - a
            continue
        while a < b:
            e = min(b, a + CHUNK)
            yield i, a, np.array([0, e - a], np.int64)
            if e == b:
                break
            a = e - length + 1


def segments_of(col: pa.Array, length: int, core: int):
    """By piece of a whole column: row in the column, start in the row, strings, bytes before the core, core hash, segment hash."""
    data, offsets = buffer_of(col)
    for i, a, off in pieces(offsets, length):
        row, start, n, before, h, s = segments(data[a : a + int(off[-1])], off, length, core)
        row = row + i
        yield row, start + a - offsets[row], n, before, h, s


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _core_counts(length: int, core: int):
    def run(batches):
        for batch in batches:
            found = [h for *_, h, _ in segments_of(batch.column(0), length, core)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([_signed(h), pa.array(n, pa.int64())], names=["h", "n"])

    return tidy(run)


#: A place is one number: start in the text, strings, bytes before the core, and 16 bits of a second hash of the text.
def _places(length: int, core: int):
    def run(batches):
        for batch in batches:
            key, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "check"))
            for row, start, n, before, h, s in segments_of(batch.column("text"), length, core):
                place = start << 32 | n << 24 | before << 16 | check[row]
                yield pa.record_batch([_signed(h), _signed(s), pa.array(key[row]), pa.array(place, pa.int64())], names=["h", "s", "d", "place"])

    return tidy(run)


def _cut_segments(length: int):
    """Segments with their bytes, equal ones of a batch counted together."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            lists = batch.column("places")
            flat, first = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            place, h, s = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((s, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])
            pick = order[new]
            count = np.diff(np.append(np.flatnonzero(new), len(order)))
            start, n, before = place[pick] >> 32, place[pick] >> 24 & 255, place[pick] >> 16 & 255
            a = offsets[row[pick]] + start
            for k in range(0, len(pick), 8192):
                part = slice(k, k + 8192)
                cut = [data[x:y].tobytes() for x, y in zip(a[part].tolist(), (a + n - 1 + length)[part].tolist())]
                yield pa.record_batch([pa.array(h[pick[part]]), pa.array(s[pick[part]]), pa.array(before[part], pa.int32()), pa.array(cut, pa.binary()), pa.array(count[part], pa.int64())], names=["h", "s", "before", "bytes", "n"])

    return tidy(run)


def _halves(level: int, length: int, core: int):
    """Deals the strings of a segment by where the core stands in them, in blocks half as wide as before."""
    block, width = 256 >> level, length - core + 1
    tag = mix(np.array([level], U64))[0]

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("bytes"))
            before = batch.column("before").to_numpy().astype(np.int64)
            size = np.diff(offsets) - length + 1  # strings
            # a string that starts i bytes into the segment has the core at before - i
            last, first = before // block, np.maximum(0, before - size + 1) // block
            times = last - first + 1
            row = np.repeat(np.arange(len(before)), times)
            b = np.repeat(last, times) - (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            high = np.minimum(before[row], b * block + block - 1)
            lo = np.maximum(before[row] - size[row] + 1, b * block)
            i, n = before[row] - high, high - lo + 1
            # the bytes that every string of the block has in common
            h, s = np.empty(len(row), U64), np.empty(len(row), U64)
            ca, cb = before[row] - b * block, before[row] - np.minimum(b * block + block - 1, width - 1) + length
            for x, y in shards(offsets, CHUNK):
                mine = slice(*np.searchsorted(row, [x, y]))
                hasher, base = Hasher(data[offsets[x] : offsets[y]]), offsets[row[mine]] - offsets[x]
                h[mine], s[mine] = hasher.spans(base + ca[mine], base + cb[mine]), hasher.spans(base + i[mine], base + i[mine] + n[mine] - 1 + length)
            with np.errstate(over="ignore"):
                h = mix(h ^ tag + batch.column("h").to_numpy().view(U64)[row] + b.astype(U64))
            a = offsets[row] + i
            cut = [data[x:y].tobytes() for x, y in zip(a.tolist(), (a + n - 1 + length).tolist())]
            take = pa.array(row)
            yield pa.record_batch(
                [batch.column("h").take(take), batch.column("s").take(take), pa.array(i), _signed(h), _signed(s), pa.array(high, pa.int32()), pa.array(cut, pa.binary()), batch.column("n").take(take)],
                names=["up_h", "up_s", "shift", "h", "s", "before", "bytes", "n"],
            )

    return tidy(run)


# ---------------------------------------------------------------- the index of a shard
def suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes or more, and their first 8 bytes; ``left`` counts the bytes to a segment's end.

    Ranks are doubled from 8 bytes on; suffixes that are alike up to the end of
    their segment are left as they are.
    """
    n = len(text)
    padded = np.concatenate([text, np.full(8, END, np.uint8)]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = key << U64(8) | padded[k : k + n]
    order = np.argsort(key)
    first = key[order]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, n))
    rank = np.empty(n + depth + 8, np.int64)
    rank[n:] = n
    rank[order] = np.repeat(heads, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    done = 8
    while done < depth and len(slots):
        slots = slots[left[order[slots]] >= done]
        at = order[slots]
        both = rank[at] << 32 | rank[at + done]
        turn = np.argsort(both)
        both, at = both[turn], at[turn]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(at)))
        # those of a group that were left out stand behind the others or before them, never between
        rank[at] = np.repeat(slots[heads], size)
        slots = slots[np.repeat(size > 1, size)]
        done *= 2
    return order, first


def open_at(text: np.ndarray, order: np.ndarray, first: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it shares fewer than ``length`` bytes with the one before.

    Common prefixes under 8 bytes are read off the first bytes.  From there on,
    an interval of suffixes with a common string is extended backward by every
    character that precedes it: a new interval begins where the common prefix is
    one byte longer than at the start of the old one.  Intervals are taken
    breadth first, so each start is found at its own value, and none is found twice.
    """
    n = len(text)
    before = text[order - 1]  # the transform
    by_char = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # the suffix that is one longer
    step[by_char] = np.arange(n, dtype=np.int32)
    prev, nxt = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    same = before[by_char[1:]] == before[by_char[:-1]]
    prev[by_char[1:][same]] = by_char[:-1][same]
    nxt[by_char[:-1][same]] = by_char[1:][same]
    differ = first[1:] ^ first[:-1]
    cut = np.ones(n + 1, bool)
    cut[1:n] = differ != 0
    starts = np.flatnonzero(cut)
    seven = np.zeros(n + 1, bool)
    seven[1:n] = (differ != 0) & (differ < U64(256))
    k = np.flatnonzero(seven[starts[:-1]] & (left[order[starts[:-1]]] >= 8))
    a, b = starts[k], starts[k + 1]
    for _ in range(8, length):
        if not len(a):
            break
        size = b - a
        who = np.repeat(np.arange(len(a)), size)
        i = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + a[who]
        inner = before[i] != END
        i, who = i[inner], who[inner]
        head, tail = step[i[prev[i] < a[who]]], step[i[nxt[i] >= b[who]]]
        head.sort()
        tail.sort()
        fresh = ~cut[head]
        a, b = head[fresh].astype(np.int64), tail[fresh].astype(np.int64) + 1
        cut[a] = True
    return cut[:n]


def repeated(texts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings of all segments, one after another: whether each occurs again; and where a segment's strings begin."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    owner = np.repeat(np.arange(len(texts)), size + 1)
    left = starts[owner + 1] - 1 - np.arange(len(text))
    order, first = suffix_array(text, left, length)
    cut = open_at(text, order, first, left, length)
    full = left[order] >= length
    cut[~full] = True
    group = np.cumsum(cut) - 1
    weight = np.bincount(group, np.where(full, np.minimum(weights, 2)[owner[order]], 0))
    found = np.zeros(len(text), bool)
    found[order] = full & (weight[group] >= 2)
    return found, starts


def runs_of(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked strings as (start << 32 | strings), and for each segment the index of its first run."""
    edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(starts, a, side="right") - 1
    return (a - starts[owner]) << 32 | (b - a), np.searchsorted(owner, np.arange(len(starts)))


def _index(length: int, full: int):
    def run(batches):
        h, s, texts, n, size = [], [], [], [], 0

        def result():
            found, starts = repeated(texts, np.array(n, np.int64), length)
            runs, first = runs_of(found, starts)
            keep = np.flatnonzero(np.diff(first))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first[keep], first[-1]), pa.int32()), pa.array(runs, pa.int64()))
            return pa.record_batch([pa.array(np.array(h, np.int64)[keep]), pa.array(np.array(s, np.int64)[keep]), lists], names=["h", "s", "runs"])

        for batch in batches:
            for x, y, t, k in zip(batch.column("h").to_pylist(), batch.column("s").to_pylist(), batch.column("bytes").to_pylist(), batch.column("n").to_pylist()):
                if size >= full and x != h[-1]:
                    yield result()
                    h, s, texts, n, size = [], [], [], [], 0
                h.append(x)
                s.append(y)
                texts.append(t)
                n.append(k)
                size += len(t) + 1
        if h:
            yield result()

    return tidy(run)


# ---------------------------------------------------------------- the whole
def _keys(text: Column) -> list[Column]:
    """A 64-bit hash of a text and 16 bits of another; the seeds come first, so that they are two functions."""
    return [F.xxhash64(F.lit(1), text).alias("d"), F.xxhash64(F.lit(2), text).bitwiseAND(F.lit(0xFFFF)).alias("check")]


def _spans(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            lists = batch.column("runs")
            removed, spans, hashes, kept, flat, ends = [], [], [], [], [], [0]
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]]
                runs = lists[r].values
                if runs is None or not len(runs):
                    a = b = np.empty(0, np.int64)
                else:
                    x = np.sort(runs.to_numpy(zero_copy_only=False))
                    start, stop = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) - 1 + length
                    far = np.maximum.accumulate(stop)
                    new = np.append(True, start[1:] > far[:-1])
                    a, b = start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
                edges = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(raw)]])
                left = b"".join(raw[x:y].tobytes() for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()))
                removed.append(len(raw) - len(left))
                spans.append(len(a))
                hashes.append(hashlib.sha256(left).hexdigest())
                flat += [a, b]
                ends.append(ends[-1] + len(a))
                if texts:
                    kept.append(left.decode("utf-8", "ignore"))
            a, b = (np.concatenate(flat[k::2]) if flat else np.empty(0, np.int64) for k in (0, 1))
            both = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"])
            cols = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.record_batch(cols + [pa.array(kept, pa.string())] * texts, names=names + ["kept"] * texts)

    return tidy(run)


def _settle(level: int, rows: DataFrame, work: Work, length: int, core: int, limit: int):
    """Splits cores with more than ``limit`` bytes of segments until none is left: rows that fit, and links from segments to their parts."""
    fit, links = [], []
    while True:
        hot = rows.groupBy("h").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > limit).select("h")
        hot = work.table(hot, "hot")
        if level == 8 or hot.isEmpty():
            return [*fit, rows], links
        fit.append(rows.join(hot, "h", "left_anti"))
        level += 1
        parts = rows.join(hot, "h", "left_semi").mapInArrow(_halves(level, length, core), "up_h long, up_s long, shift long, h long, s long, before int, bytes binary, n long")
        parts = work.table(parts, "parts")
        links.append(parts.select("up_h", "up_s", "shift", "h", "s"))
        # a part that stands alone repeats nothing
        again = parts.groupBy("h").agg(F.sum("n").alias("c")).where("c > 1").select("h")
        rows = parts.join(again, "h", "left_semi").groupBy("h", "s", "before", "bytes").agg(F.sum("n").alias("n"))
        rows = work.table(rows, "segments")


def repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, texts: bool = False, limit: int = GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else,
    in the same text or another; strings are judged on the input.  ``texts`` adds
    ``kept``, the remaining text, without a character of which a part was removed.
    A null or empty text has no bytes, and one shorter than ``length`` keeps all;
    rows that repeat repeat each other's text, so those of ``length`` bytes or
    more lose all of it; an empty table gives none.  A null doc_id is kept, and
    other columns are ignored.
    """
    if not 8 < core <= length or length - core > 254:
        raise ValueError("a core has more than 8 bytes, and fewer than 255 stand beside it")
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "repeats")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = docs.where(F.octet_length("text") >= length).select(*_keys(F.col("text")), "text")
    counts = long.select("text").mapInArrow(_core_counts(length, core), "h long, n long")
    again = work.table(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "cores")
    places = long.mapInArrow(_places(length, core), "h long, s long, d long, place long").join(again, "h", "left_semi")
    places = work.table(places, "places")
    check = F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("check")
    # equal texts have equal places, which a set keeps once, on the map side too
    by_text = places.groupBy("d", check).agg(F.collect_set(F.struct("place", "h", "s")).alias("places"))
    by_text = work.table(by_text, "by_text")  # read back, so that the join can split a text with many copies
    cut = long.join(by_text, ["d", "check"]).select("text", "places").mapInArrow(_cut_segments(length), "h long, s long, before int, bytes binary, n long")
    rows = work.table(cut.groupBy("h", "s", "before", "bytes").agg(F.sum("n").alias("n")), "segments")
    fit, links = _settle(0, rows, work, length, core, limit)
    every = fit[0]
    for part in fit[1:]:
        every = every.unionByName(part)
    found = every.repartition("h").sortWithinPartitions("h").select("h", "s", "bytes", "n").mapInArrow(_index(length, max(limit, INDEX_BYTES)), "h long, s long, runs array<long>")
    found = work.table(found, "runs")
    at = found
    for link in reversed(links):
        at = link.join(at, ["h", "s"]).select(F.col("up_h").alias("h"), F.col("up_s").alias("s"), F.expr("transform(runs, x -> x + shiftleft(shift, 32))").alias("runs"))
        at = at.unionByName(found)
    run = F.explode(F.expr("transform(runs, x -> x + shiftleft(shiftright(place, 32), 32))")).alias("run")
    covered = places.join(at, ["h", "s"]).select("d", check, run).groupBy("d", "check").agg(F.collect_set("run").alias("runs"))
    covered = work.table(covered, "covered")
    all_rows = docs.select("doc_id", "text", *_keys(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = all_rows.join(covered, ["d", "check"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_spans(length, texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept string" * texts)
