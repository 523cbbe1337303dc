"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies (its source's target over its
source's size).  The whole part is taken as it is; the fractional parts of a
source are rounded together: two documents with fractions p and q trade mass
between them, weighted by their sizes so that the expected words stay the same,
until one of them is 0 or 1, and the other goes on to the next.  Blocks of a
source are reduced side by side, their single residuals are reduced again, and
so on up a tree, so no task ever holds a whole source.

Rows that are equal in every column are one entry with a multiplicity: their
copies are counted together and dealt evenly among them, so that rows which
repeat by the million are reduced before they move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Work, mix, small

#: Documents that one task of the tree reduces together.
BLOCK = 2000
WEIGHTS = (5.0, 2.0, 1.0)
EPS = 1e-9


def word_count(text: str = "text") -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; 0 for null."""
    blanks = F.lit(" \t\n\x0b\f\r")
    inner = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), blanks)
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.size(F.split(inner, "[ \\t-\\r]+"))).cast("long")


def ranked(keys: DataFrame, col: str, work: Work) -> DataFrame:
    """Distinct keys with their position (0-based) in ascending order, nulls last, without one task seeing all."""
    order = F.col(col).asc_nulls_last()
    placed = work.table(keys.select(col).distinct().repartitionByRange(order).withColumn("pid", F.spark_partition_id()), "keys")
    sizes = sorted((r["pid"], r["n"]) for r in placed.groupBy("pid").agg(F.count("*").alias("n")).collect())  # a row for each partition
    base, rows = 0, []
    for pid, n in sizes:
        rows.append((pid, base))
        base += n
    starts = keys.sparkSession.createDataFrame(rows, "pid int, base long")
    within = F.row_number().over(Window.partitionBy("pid").orderBy(order))
    return placed.join(F.broadcast(starts), "pid").select(col, (within - 1 + F.col("base")).alias("position"))


def targets(sources: DataFrame, work: Work, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with target: ``share`` of all sizes by weight, none above ``cap`` times its size.

    What a capped source gives up is dealt again by weight among the others until
    none is above; with share < cap that always fits.
    """
    order = ranked(sources, "source", work)
    named = sources.join(small(order, order.count()), sources["source"].eqNullSafe(order["source"])).select(sources["source"], "source_size", "position")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    named = work.table(named.select("source", "source_size", pick.alias("weight")), "weights")
    total = named.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, limit = 0.0, F.col("source_size") * cap
    while total:
        above = F.col("weight") * level > limit if level else F.lit(False)
        r = named.agg(F.sum(F.when(above, limit).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        now = (share * total - r["full"]) / r["open"]
        if level and now <= level * (1 + 1e-12):
            break
        level = now
    return named.select("source", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in order; returns them with 0 or 1 for all but one, and the index of that one (-1: none)."""
    p = p.copy()
    hand = -1
    for k in range(len(p)):
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = round(p[k])
            continue
        if hand < 0:
            hand = k
            continue
        a, b = size[hand], size[k]
        up = min((1 - p[hand]) * a, p[k] * b)  # words that may go to the one in hand
        down = min(p[hand] * a, (1 - p[k]) * b)  # or from it
        shift = up if luck[k] * (up + down) < down else -down
        p[hand] += shift / a
        p[k] -= shift / b
        for i in (hand, k):
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = round(p[i])
        open_ = [i for i in (hand, k) if 0 < p[i] < 1]
        hand = open_[0] if open_ else -1
    return p, hand


_STATE = "doc_id long, rid long, many long, grp long, block long, size long, whole long, p double, open boolean"


def _reduce(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].fillna(-1).to_numpy(np.int64).view(U64)
        rid = pdf["rid"].to_numpy(np.int64).view(U64)
        with np.errstate(over="ignore"):
            h = mix(ids * U64(2) + U64(2 * seed + 1) * U64(0x9E3779B9) + U64(level) * U64(0x51ED27))
        size = pdf["size"].to_numpy(np.int64)
        # large documents first: what is left over is then a small one
        order = np.lexsort((rid, ids, size, h, -np.floor(np.log2(size))))
        pdf = pdf.iloc[order].reset_index(drop=True)
        with np.errstate(over="ignore"):
            luck = (mix(h[order] + rid[order] + U64(77)) >> U64(11)).astype(float) / (1 << 53)
        p, hand = pivot(pdf["p"].to_numpy(float), size[order].astype(float), luck)
        if last and hand >= 0:
            p[hand] = float(p[hand] >= 0.5)  # so a source misses its target by half a document at most
            hand = -1
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == hand
        return pdf

    return run


def _rounded(state: DataFrame, work: Work, seed: int, most_docs: int) -> DataFrame:
    """Reduces the fractions level by level until each source has no residual left."""
    done, level, blocks = None, 0, max(1, -(-most_docs // BLOCK))
    while True:
        last = blocks <= 1
        out = work.table(state.groupBy("grp", "block").applyInPandas(_reduce(seed, level, last), _STATE), f"level{level}")
        settled = out.where("not open")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        blocks, level = -(-blocks // BLOCK), level + 1
        # each block left one residual at most; those of BLOCK neighbouring blocks meet
        state = out.where("open").withColumn("block", F.floor(F.col("block") / BLOCK))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which cannot be hashed, by their entries in order."""
    cols = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    # a null must not hash like the column that is missing
    return F.xxhash64(*cols, *[F.isnull(c) for c in cols])


def _rows(docs: DataFrame, rid: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), rid.alias("rid"), word_count().alias("size"))


def _plan(rows: DataFrame, weights, share: float, cap: float, seed: int, work: Work) -> DataFrame:
    """What the mix takes of ``rows`` (doc_id, source, rid, size).

    One row for each different (doc_id, source, rid, size): those, many (rows that
    are equal), source_size, target, and copies, of all ``many`` together.
    """
    same = work.table(rows.groupBy("doc_id", "source", "rid", "size").agg(F.count("*").alias("many")), "sized")
    sources = work.table(same.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("docs")), "sources")
    goal = targets(sources.select("source", "source_size"), work, weights, share, cap)
    goal = goal.join(sources.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = work.table(goal.withColumn("grp", F.xxhash64("source", F.isnull("source"))), "targets")
    most_docs, n_sources = goal.agg(F.max("docs"), F.count("*")).first()
    per = small(goal.select(F.col("source").alias("s"), "source_size", "target", "docs", "grp"), n_sources)
    full = same.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    want = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("many")
    # equal rows want whole * many copies together, and one part of a copy more
    full = full.withColumn("whole", F.floor(want + EPS * F.col("many"))).withColumn("p", F.greatest(want - F.col("whole"), F.lit(0.0)))
    block = F.pmod(F.xxhash64("doc_id", "rid", F.lit(seed)), F.ceil(F.col("docs") / BLOCK))
    state = full.select("doc_id", "rid", "many", "grp", block.alias("block"), "size", "whole", "p", F.lit(False).alias("open"))
    settled = _rounded(state.where(F.col("p") > EPS), work, seed, most_docs or 0)
    all_ = settled.unionByName(state.where(F.col("p") <= EPS).withColumn("p", F.lit(0.0)))
    all_ = all_.select("doc_id", "rid", "many", "size", "grp", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    named = small(goal.select("grp", "source", "source_size", "target"), n_sources)
    return all_.join(named, "grp").drop("grp")


def _share(copies: str, many: str, k: Column) -> Column:
    """Copies of the k-th (from 0) of ``many`` equal rows."""
    return (F.floor(F.col(copies) / F.col(many)) + F.when(k < F.col(copies) % F.col(many), 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target, copies, taken.

    Size is the number of words (null text: 0).  Sources are weighed in code point
    order, null last.  A document of size 0 is taken 0 times.  Rows that repeat a
    doc_id, and rows without one, are separate documents.  Decisions depend on the
    rows and ``seed`` only, so reruns agree.  An empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "mix")
    plan = _plan(_rows(docs, _row_hash(docs)), weights, share, cap, seed, work)
    each = plan.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).withColumn("copies", _share("copies", "many", F.col("k")))
    return each.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` in its own columns, each row as often as ``mix_sources`` takes it.

    Rows that repeat a doc_id, and rows without one, are decided one by one; rows
    equal in all columns share their copies evenly.  Texts of size 0 go.
    """
    work = Work(docs.sparkSession, "mix")
    keyed = docs.withColumn("_rid", _row_hash(docs))
    plan = work.table(_plan(_rows(keyed, F.col("_rid")), weights, share, cap, seed, work).where("copies > 0").select(F.col("rid").alias("_rid"), F.col("many").alias("_many"), F.col("copies").alias("_all")), "plan")
    joined = keyed.join(plan.where("_many = 1"), "_rid").withColumn("_copies", F.col("_all"))
    # rows that are equal in all columns are numbered; any order of them will do
    again = keyed.join(plan.where("_many > 1"), "_rid").withColumn("_k", F.row_number().over(Window.partitionBy("_rid").orderBy(F.lit(0))) - 1)
    again = again.withColumn("_copies", _share("_all", "_many", F.col("_k"))).drop("_k")
    if plan.where("_many > 1").limit(1).count():
        joined = joined.unionByName(again)
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).where("_copies > 0").select(*docs.columns)
