"""Near simhashes and signatures: they meet in buckets, and tasks compare the members of a bucket as blocks.

A bucket is what agrees under one mask, or in one band.  Pairs are compared in numpy, and only what
is asked for leaves a task: the near pairs, or for each hash the first of those near
it, which is a row for a hash and bucket at most, however many pairs there are.
Buckets of one are left out; a large one is split into tiles, so that its members
meet in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut, ship

#: Members of a bucket that meet in one task; of more, every two parts do.
TILE = 8192
#: Rows that are worked on together; buckets up to so many members are compared side by side.
ROWS, SMALL = 1 << 16, 64
#: Open hashes that one task resolves in order.
FEW = 16384
#: Bits of ``flags``: others may be near this one, this one asks for those near it.
ORIGIN, ASKS, BOTH = 1, 2, 3


def _met(nodes: DataFrame, masks: list[int], tile: int) -> DataFrame:
    """(bucket, meta, flags, simhash, id) of ``nodes`` (simhash, id, flags), in order; meta is the mask and the tile, flags // 4 the side in it."""
    keys = F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")
    sizes = nodes.select(keys).groupBy("mask", "key").count().where("count > 1")
    # shuffled by a hint: the planner knows the rows' size before they are exploded only, and would broadcast them through the driver
    met = nodes.select("simhash", "id", "flags", keys).join(sizes.hint("shuffle_hash"), ["mask", "key"])
    met = _tiled(met, "simhash", tile).select(
        F.xxhash64("mask", "key", "t.tile").alias("bucket"), (F.col("t.tile") * 65536 + F.col("mask")).alias("meta"), (F.col("flags") + F.col("t.side")).cast("byte").alias("flags"), "simhash", "id"
    )
    return met.repartition("bucket").sortWithinPartitions("bucket", "meta")


def _tiled(met: DataFrame, by: str, tile: int) -> DataFrame:
    """Members of buckets of ``count``, once for each tile ``t`` (tile, side) that they belong to; one tile without sides if it holds them all."""
    parts = F.ceil(F.col("count") / tile)
    part = F.pmod(F.xxhash64(by), parts)
    side = lambda j: F.when(j > part, 4).when(j < part, 8).otherwise(0)
    one = lambda j: F.struct((F.least(part, j) * parts + F.greatest(part, j)).alias("tile"), side(j).alias("side"))
    return met.select("*", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), one)).alias("t"))


def _new(bucket: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Where a bucket begins, but for the first."""
    return np.flatnonzero((bucket[1:] != bucket[:-1]) | (meta[1:] != meta[:-1])) + 1


def _column(c: pa.Array) -> np.ndarray:
    """Values, or for lists of one length a row of values for each."""
    return c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)


def _whole(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[np.ndarray]]:
    """The columns in chunks of whole buckets."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([_column(c) for c in b.columns])
        n += b.num_rows
        if n >= rows:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = _new(cols[0], cols[1])
            last = int(new[-1]) if len(new) else 0
            if last:
                yield [c[:last] for c in cols]
            held, n = [[c[last:] for c in cols]], n - last
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _near(cols: list[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one bucket, of different sides if it has sides, that are near: each pair once."""
    bucket, meta, flags, h, _ = cols
    side = flags >> 2
    begin = np.concatenate([[0], _new(bucket, meta)])
    end = np.append(begin[1:], len(h))
    size = end - begin
    stop, i, step = np.repeat(end, size), np.flatnonzero(np.repeat(size <= SMALL, size)), 0
    while len(i):
        step += 1
        i = i[i + step < stop[i]]
        near = np.bitwise_count(h[i] ^ h[i + step]) <= distance
        found = i[near]
        found = found[(side[found] == 0) | (side[found] != side[found + step])]
        if len(found):
            yield found, found + step
    for k in np.flatnonzero(size > SMALL):
        rows = np.arange(begin[k], end[k])
        sides = side[rows]
        split = bool(sides.any())
        left, right = (rows[sides == 1], rows[sides == 2]) if split else (rows, rows)
        for p in range(0, len(left), 128):
            a = left[p : p + 128]
            others = right if split else right[p:]
            for q in range(0, len(others), 2048):
                b = others[q : q + 2048]
                near = np.bitwise_count(h[a][:, None] ^ h[b][None, :]) <= distance
                x, y = np.nonzero(near if split or q else np.triu(near, 1))
                if len(x):
                    yield a[x], b[y]


def _gathered(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same in larger pieces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= ROWS:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def _pairs(masks: list[int], distance: int):
    """Near pairs under the first mask that they agree under, so that pairs need not be shuffled to be made distinct."""
    bits = [np.int64(m) for m in masks]

    def run(batches: Iterable[pa.RecordBatch]):
        for cols in _whole(batches):
            h, mask = cols[3], cols[1] & 65535
            for i, j in _gathered(_near(cols, distance)):
                differ, own = h[i] ^ h[j], mask[i]
                first = np.full(len(i), len(bits))
                left = np.arange(len(i))
                for k in range(int(own.max()) + 1):
                    agree = (differ[left] & bits[k]) == 0
                    first[left[agree]] = k
                    left = left[~agree & (own[left] > k)]
                    if not len(left):
                        break
                keep = first == own
                x, y = h[i[keep]], h[j[keep]]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.bitwise_count(x ^ y).astype(np.int32))], names=["x", "y", "distance"])

    return run


def pairs(hashes: DataFrame, masks: list[int], distance: int, tile: int = TILE) -> DataFrame:
    """(x, y, distance) of different hashes x < y that agree under a mask and are near."""
    ship(hashes.sparkSession)
    nodes = hashes.select("simhash", F.col("simhash").alias("id"), F.lit(BOTH).alias("flags"))
    return _met(nodes, masks, tile).mapInArrow(_pairs(masks, distance), "x long, y long, distance int")


def _first(distance: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for cols in _whole(batches):
            flags, ids = cols[2], cols[4]
            none = np.iinfo(np.int64).max
            first = np.full(len(ids), none)
            for i, j in _near(cols, distance):
                early = ids[i] < ids[j]
                a, b = np.where(early, i, j), np.where(early, j, i)
                asked = ((flags[a] & ORIGIN) > 0) & ((flags[b] & ASKS) > 0)
                np.minimum.at(first, b[asked], ids[a[asked]])
            some = first < none
            yield pa.record_batch([pa.array(ids[some]), pa.array(first[some])], names=["id", "first"])

    return run


def earliest(nodes: DataFrame, masks: list[int], distance: int, tile: int = TILE) -> DataFrame:
    """(id, first) of ``nodes`` (simhash, id, flags), a row for each hash: the smallest id of an origin before it and near it; others have no row."""
    ship(nodes.sparkSession)
    return _met(nodes, masks, tile).mapInArrow(_first(distance), "id long, first long").groupBy("id").agg(F.min("first").alias("first"))


def _in_order(distance: int):
    def run(batches: Iterable[pa.RecordBatch]):
        got = [(b.column("simhash").to_numpy(), b.column("id").to_numpy()) for b in batches]
        if not got:
            return
        h, ids = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.argsort(ids)
        h, ids = h[order], ids[order]
        leads = np.ones(len(h), bool)
        for i in range(len(h)):
            if leads[i]:
                leads[i + 1 :] &= np.bitwise_count(h[i + 1 :] ^ h[i]) > distance
        yield pa.record_batch([pa.array(h[leads]), pa.array(ids[leads])], names=["simhash", "id"])

    return run


def resolve(hashes: DataFrame, masks: list[int], distance: int, few: int = FEW, tile: int = TILE) -> DataFrame:
    """Greedy leaders of ``hashes`` (simhash, id), a row for each hash: (node, leader, original), null for a leader.

    A hash is a leader when no leader before it is near; otherwise its original is
    the earliest such leader.  In each round all open hashes without an open one
    before and near them lead, the smallest among them, and those near them close;
    the last few are resolved in one task.  No pair leaves a task.
    """
    spark = hashes.sparkSession
    ship(spark)
    hashes = cut(hashes.select("simhash", "id"), spark)
    still, leaders = hashes, hashes.limit(0)
    while still.limit(few + 1).count() > few:
        before = earliest(still.withColumn("flags", F.lit(BOTH)), masks, distance, tile)
        marked = cut(still.join(before, "id", "left").select("simhash", "id", F.when(F.col("first").isNull(), ORIGIN).otherwise(ASKS).alias("flags")), spark)
        leaders = leaders.unionByName(marked.where(F.col("flags") == ORIGIN).select("simhash", "id"))
        still = cut(marked.where(F.col("flags") == ASKS).join(earliest(marked, masks, distance, tile), "id", "left_anti").select("simhash", "id"), spark)
    leaders = cut(leaders.unionByName(still.coalesce(1).mapInArrow(_in_order(distance), "simhash long, id long")).select("id", F.lit(True).alias("leader")), spark)
    nodes = cut(hashes.join(leaders, "id", "left").select("simhash", "id", F.coalesce("leader", F.lit(False)).alias("leader")), spark)
    first = earliest(nodes.select("simhash", "id", F.when(F.col("leader"), ORIGIN).otherwise(ASKS).alias("flags")), masks, distance, tile)
    return nodes.join(first, "id", "left").select(F.col("id").alias("node"), "leader", F.col("first").alias("original"))


def _alike(rows: int):
    """Members of a bucket, which is a band of ``rows`` positions, compared in all positions; pairs come in the first band that they agree in."""

    def run(batches: Iterable[pa.RecordBatch]):
        for bucket, meta, side, ids, signature in _whole(batches, ROWS // 8):
            begin = np.concatenate([[0], _new(bucket, meta)])
            end = np.append(begin[1:], len(ids))
            stop, band, i, step = np.repeat(end, end - begin), meta & 65535, np.arange(len(ids)), 0
            bands = signature.shape[1] // rows
            while len(i):
                step += 1
                i = i[i + step < stop[i]]
                a = i[(side[i] == 0) | (side[i] != side[i + step])]
                if not len(a):
                    continue
                b = a + step
                same = signature[a] == signature[b]
                agree = same[:, : bands * rows].reshape(len(a), bands, rows).all(axis=2)
                keep = agree.any(axis=1) & (agree.argmax(axis=1) == band[a])
                x, y = ids[a[keep]], ids[b[keep]]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(same[keep].mean(axis=1))], names=["a", "b", "similarity"])

    return run


def signature_pairs(signed: DataFrame, rows: int, tile: int = TILE // 4) -> DataFrame:
    """(a, b, similarity) of different signatures (id, signature array<int>) that agree in a band of ``rows`` positions.

    Signatures move to buckets of more than one only, and of bands with the same
    members to the first: copies with few changes share most of their bands.
    """
    ship(signed.sparkSession)
    bands = F.transform(F.sequence(F.lit(0), (F.size("signature") / rows).cast("int") - 1), lambda i: F.slice("signature", i * rows + 1, rows))
    at = ["k", "k2"]  # 128 bits stand for a band's place and values; members are compared in all positions
    keys = signed.select("id", F.posexplode(bands).alias("n", "band")).select("id", "n", F.xxhash64("n", "band").alias("k"), F.xxhash64("n", "band", F.lit(1)).alias("k2"))
    # shuffled by hints: the planner knows the rows' size before they are exploded only
    sizes = keys.groupBy(*at).count().where("count > 1").select(*at)
    shared = cut(keys.join(sizes.hint("shuffle_hash"), at), signed.sparkSession)
    members = [F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")]
    sets = shared.groupBy("n", *at).agg(F.count("*").alias("count"), *members)
    first = sets.groupBy("count", "h", "h2").agg(F.min(F.struct("n", *at)).alias("s")).select("s.k", "s.k2", "count")
    met = _tiled(shared.join(first.hint("shuffle_hash"), at), "id", tile)
    met = met.select(F.xxhash64(*at, "t.tile").alias("bucket"), (F.col("t.tile") * 65536 + F.col("n")).alias("meta"), F.col("t.side").cast("byte").alias("side"), "id")
    met = met.join(signed.hint("shuffle_merge"), "id").select("bucket", "meta", "side", "id", "signature")
    return met.repartition("bucket").sortWithinPartitions("bucket", "meta").mapInArrow(_alike(rows), "a long, b long, similarity double")
