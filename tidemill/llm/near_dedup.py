"""Near-duplicate documents by min-max hashing.

Each of ``perms`` permutations of a document's word shingles gives two signature
values, its minimum and its maximum, so the signature is twice as long as the
number of hash evaluations.  Bands of ``rows`` values propose candidates; every
link is then confirmed on the full shingle sets.

Work is kept linear in the presence of very large groups:

* documents with equal sets become one node before any pair exists;
* in a band bucket, every member is first compared with the bucket's most
  popular member only (the sum of its bucket sizes; in a group of edited copies
  that is the text they were edited from);
* members of one bucket that those links already put into one component need no
  further comparison; only pairs between different components remain.  The
  members outside the bucket's largest component are compared with all of its
  members in tiles of bounded bytes: a member of the largest component is sent
  once for each part of the others, which are few.  Tiles decide in numpy on the
  full sets and return one link between two components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, VISIBLE, Work, buffer_of, lower, mix, release, shards, span_hashes, stream, tidy, words_of
from .components import components

_GRAM = stream(11, 64) | U64(1)
_SHORT = stream(12, 4096) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct shingle hashes of each row: (values, row offsets); sorted within a row."""
    low = lower(data)
    starts, ends, first = words_of(low, offsets, VISIBLE)
    h = span_hashes(low, starts, ends)
    n = np.diff(first)
    out = []
    with np.errstate(over="ignore"):
        grams = np.empty(0, U64)
        if len(h) >= width:
            grams = np.zeros(len(h) - width + 1, U64)
            for k in range(width):
                grams += h[k : len(h) - width + 1 + k] * _GRAM[k]
            grams = mix(grams)
        for i in range(len(n)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _SHORT[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
            else:
                out.append(np.empty(0, U64))
    at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return (np.concatenate(out) if out else np.empty(0, U64)), at


def signatures(values: np.ndarray, at: np.ndarray, perms: int) -> np.ndarray:
    """(rows, 2 * perms) signatures as 32-bit values, all minima before all maxima; rows without shingles are zeros.

    Neighbouring values are of different permutations: a minimum and a maximum of
    the same one agree together less often than two independent values do.
    """
    out = np.zeros((len(at) - 1, 2 * perms), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    cuts = at[full]
    mul, add = stream(21, perms) | U64(1), stream(22, perms)
    with np.errstate(over="ignore"):
        for p in range(perms):
            x = values * mul[p]
            x ^= x >> U64(32)
            x *= add[p] | U64(1)
            x >>= U64(32)
            x = x.astype(np.uint32)
            out[full, p] = np.minimum.reduceat(x, cuts)
            out[full, perms + p] = np.maximum.reduceat(x, cuts)
    return out


def _sketch(width: int, perms: int, rows: int, full: bool = False):
    bands = 2 * perms // rows
    salt, mul = stream(31, bands), stream(32, 2 * perms) | U64(1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            data, offsets = buffer_of(batch.column(1))
            for i, j in shards(offsets):
                values, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(at)
                sig = signatures(values, at, perms)
                with np.errstate(over="ignore"):
                    key = mix((sig.astype(U64) * mul).reshape(len(n), bands, rows).sum(axis=2, dtype=U64) + salt)
                    sums = np.zeros((2, len(n)), U64)
                    some = np.flatnonzero(n)
                    if len(some):
                        sums[0, some] = np.add.reduceat(mix(values + U64(5)), at[some])
                        sums[1, some] = np.add.reduceat(mix(values + U64(6)), at[some])
                live = n > 0
                cols = {
                    "doc_id": ids.slice(i, j - i),
                    "n_shingles": pa.array(n, pa.int64()),
                    "d1": pa.array(sums[0].view(np.int64)),
                    "d2": pa.array(sums[1].view(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(live * bands)]).astype(np.int32)), pa.array(key[live].ravel().view(np.int64))),
                }
                if full:
                    cols["members"] = pa.array([values[at[r] : at[r + 1]].tobytes() for r in range(len(n))], pa.binary())
                    cols["keys"] = pa.array([key[r].tobytes() if live[r] else b"" for r in range(len(n))], pa.binary())
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return tidy(run)


def sketch(docs: DataFrame, width: int, perms: int, rows: int, full: bool = False) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys): set size, set digest and band keys; with ``full`` also members, the set, and both as bytes."""
    cols = "doc_id long, n_shingles long, d1 long, d2 long, " + ("keys binary, members binary" if full else "keys array<long>")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch(width, perms, rows, full), cols)


#: Bytes of sets that a task remembers while it confirms pairs.
KEPT_BYTES = 16 << 20


def _confirm(width: int, num: int, den: int):
    """Keeps the pairs whose exact similarity reaches num / den."""

    def run(batches):
        kept: dict[str, np.ndarray] = {}
        held = 0

        def of(text) -> np.ndarray:
            nonlocal held
            text = text or ""
            if text not in kept:
                raw = np.frombuffer(text.encode(), np.uint8)
                got = shingle_sets(raw, np.array([0, len(raw)], np.int64), width)[0]
                cost = got.nbytes + 2 * len(raw) + 500
                while kept and (held + cost > KEPT_BYTES or len(kept) >= 64):
                    first = next(iter(kept))
                    held -= kept.pop(first).nbytes + 2 * len(first) + 500
                kept[text] = got
                held += cost
            return kept[text]

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = of(ta[i].as_py()), of(tb[i].as_py())
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = den * both >= num * (len(x) + len(y) - both)
            keep = pa.array(keep)
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return tidy(run)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough; b may repeat very often."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("b", "a", "tb", "ta").mapInArrow(_confirm(width, *threshold), "a long, b long")


def _tile_links(num: int, den: int):
    """Links between different components in one tile: a part of a bucket's outsiders (side 0) against a part of all its members (side 1).

    A pair is looked at in the first band that its members share, and two outsiders
    from the one of the smaller id.  Pairs of too different lengths cannot be
    similar enough, the rest is decided on the full sets; of the links between two
    components one is returned.
    """

    def run(pdf):
        import pandas as pd

        key = pdf["key"].iloc[0]
        keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(len(pdf), -1)
        here = (keys == key).any(axis=1)  # not so for another text of a repeated id
        pdf, keys = pdf[here], keys[here]
        band = int((keys[0] == key).argmax()) if len(pdf) else 0
        ids, n, side, out = (pdf[c].to_numpy() for c in ("node", "n_shingles", "side", "outside"))
        _, comp = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x, U64) for x in pdf["members"]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        got = []
        for i in left:
            js = right[(comp[right] != comp[i]) & (~out[right] | (ids[right] > ids[i]))]
            js = js[den * np.minimum(n[js], n[i]) >= num * np.maximum(n[js], n[i])]
            js = js[(keys[js] == keys[i]).argmax(axis=1) == band] if len(js) else js
            for s in _portions(n[js], _PORTION):
                some = js[s][comp[js[s]] != comp[i]]
                if not len(some):
                    continue
                values = np.concatenate([sets[j] for j in some])
                at = np.searchsorted(sets[i], values)
                same = sets[i][np.minimum(at, len(sets[i]) - 1)] == values
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(n[some])[:-1]]), dtype=np.int64)
                for j in some[den * both >= num * (n[some] + n[i] - both)]:
                    if comp[j] != comp[i]:
                        got.append((ids[i], ids[j]))
                        comp[comp == comp[j]] = comp[i]
        got = np.array(got, np.int64).reshape(-1, 2)
        release()
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return run


#: Shingles that are compared with one set at once.
_PORTION = 1 << 17


def _portions(n: np.ndarray, limit: int):
    """Slices of ``n`` whose sums are about ``limit``."""
    upto, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
        yield slice(a, b)
        a = b


def tiles(placed: DataFrame, tile: int) -> DataFrame:
    """Members of buckets with more than one component, dealt to tiles: key, node, root, side, outside, lo, hi.

    ``placed`` is (key, node, root, n_shingles).  The outsiders of a bucket (all
    but its largest component) are side 0, all members are side 1; each is cut into
    parts of about ``tile`` bytes of sets, and a tile is one part of each.
    """
    weight = F.greatest(F.col("n_shingles") * 8, F.lit(512))  # the loop costs something for a short set too
    by_root = placed.groupBy("key", "root").agg(F.sum(weight).alias("w"))
    heads = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top")).where("roots > 1")
    heads = heads.select("key", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.w")) / tile).cast("int").alias("outs"), F.ceil(F.col("all") / tile).cast("int").alias("alls"))
    m = placed.select("key", "node", "root").join(heads, "key").withColumn("outside", F.col("root") != F.col("top"))
    part = lambda n, k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = m.where("outside").select("key", "node", "root", F.lit(0).alias("side"), "outside", part("outs", 0).alias("lo"), each("alls").alias("hi"))
    b = m.select("key", "node", "root", F.lit(1).alias("side"), "outside", each("outs").alias("lo"), part("alls", 1).alias("hi"))
    return a.unionByName(b)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (75, 100),
    perms: int = 64,
    rows: int = 4,
    tile: int = 1 << 20,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of non-blank characters, A-Z lower-cased; a text of fewer than
    ``width`` words is one shingle of all of them.  A null, empty or blank text has
    no set (0) and is its own component.  Rows are linked when |A∩B| / |A∪B| is at
    least ``threshold``; component_id is the smallest doc_id reachable.  Rows that
    repeat a doc_id are linked by their texts and returned as often; a null doc_id
    keeps a null component_id and is kept.  Other columns are ignored.  With 64
    permutations and bands of 4 rows a pair at 0.75 is missed with a probability
    of 5e-6 at most, and of 1e-6 when its sets have 4 shingles together
    (``miss_probability``); pairs of equal sets are never missed.
    """
    num, den = threshold
    work = Work(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = work.table(sketch(docs, width, perms, rows), "sketch")

    # one node for each set
    named = sk.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    sets = work.table(sets, "sets")
    nodes = named.join(sets.select(F.col("node").alias("doc_id"), F.col("d1"), F.col("d2")), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    keys = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"), "n_shingles")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = work.table(keys.join(shared, "key"), "members")

    fame = members.groupBy("node").agg(F.sum("size").alias("fame"))
    # the most popular member of each bucket; on a tie the smallest id
    hubs = members.join(fame, "node").groupBy("key").agg(
        F.max(F.struct("fame", (-F.col("node")).alias("m"), "n_shingles")).alias("h")
    ).select("key", (-F.col("h.m")).alias("hub"), F.col("h.n_shingles").alias("n_hub"))
    long_enough = F.expr(f"{den} * least(n_shingles, n_hub) >= {num} * greatest(n_shingles, n_hub)")
    stars = members.join(hubs, "key").where("node <> hub").where(long_enough).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    texts = work.table(docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    links = work.table(confirm(stars, texts, width, threshold), "links")

    # what may still link different components
    comp = components(links, work)
    placed = members.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = work.table(placed, "placed")
    dealt = work.table(tiles(placed, tile), "tiles")
    open_ = dealt.select(F.col("node").alias("doc_id")).distinct()
    sets_of = sketch(texts.join(open_, "doc_id", "left_semi"), width, perms, rows, full=True)
    signed = dealt.join(sets_of.select(F.col("doc_id").alias("node"), "n_shingles", "keys", "members"), "node")
    late = signed.groupBy("key", "lo", "hi").applyInPandas(_tile_links(num, den), "a long, b long")
    linked = work.table(links.unionByName(late), "all-links")
    comp = components(linked, work)

    roots = work.table(sets.join(comp, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root")), "roots")
    # a repeated doc_id with different texts joins their components
    again = named.groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("n")).where("n > 1").select("doc_id")
    extra = named.join(again, "doc_id").join(roots, ["d1", "d2"]).select(F.col("root").alias("a"), F.col("doc_id").alias("b"))
    if extra.limit(1).count():
        over = components(extra.unionByName(roots.select(F.col("root").alias("a"), F.col("root").alias("b"))), work)
        roots = roots.join(over.withColumnRenamed("root", "top").withColumnRenamed("node", "root"), "root", "left").select("d1", "d2", F.coalesce("top", "root").alias("root"))
    out = sk.select("doc_id", "n_shingles", "d1", "d2").join(roots, ["d1", "d2"], "left")
    found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def miss_probability(similarity: float, perms: int = 64, rows: int = 4, union: int | None = None) -> float:
    """Probability that no band of a pair agrees, for sets of ``union`` shingles together or for large ones.

    A band of minima and the band of maxima of the same permutations depend on each
    other: of n shingles, s of them shared, both ends are shared with s (s - 1) / (n (n - 1)).
    """
    ends = similarity**2
    if union is not None:
        ends = similarity * (similarity * union - 1) / (union - 1) if union > 1 else similarity
    return math.pow(1 - 2 * math.pow(similarity, rows) + math.pow(ends, rows), perms // rows)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group, in its own columns.

    The document of the smallest doc_id stays, in all its rows; documents without
    shingles and rows without doc_id stay.
    """
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
