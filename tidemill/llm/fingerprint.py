"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its words (A-Z lower-cased, cut at blanks) with their
counts.  For sample i and term k two gamma variables r and c and a uniform b are
read off one hash of (k, i), the gamma ones through a table of quantiles.  With t = floor(ln(weight) / r + b) the term's value is
ln(c) - r (t - b + 1), and the sample is the (term, t) of the least value.  Two
texts share a sample with a probability equal to the generalised Jaccard
similarity of their weighted sets, the sum of minima over the sum of maxima.

Texts are explained to Spark as one shuffle: rows go to buckets of neighbouring
ids, each with a copy of the row that follows its last one, so "the next
document", the words, their counts and the samples are all found in one place.
Buckets are cut at quantiles of a sample, weighted by bytes, in order of (doc_id,
hash of the text), so neither crowded nor equal ids share one bucket.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small

SAMPLES = 64
#: Samples that one row of the aggregation carries: few, so that its code stays small enough to be compiled.
GROUP = 2
#: Cells of the quantile table of the gamma distribution.
CELLS = 256
#: Bytes of text to a bucket and to a partition; and the cut points that the driver holds: with more text (128 GB) buckets grow.
BUCKET_BYTES = 1 << 20
PARTITION_BYTES = 4 << 20
CUTS = 1 << 17
#: Sampled rows to a bucket.
SAMPLE_ROWS = 16
BLANKS = "[ \\t-\\r]+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gamma_quantiles(cells: int = CELLS) -> list[float]:
    """Quantiles of the gamma distribution of shape 2 at the squares of 0, 1/cells, ... 1, by bisection.

    Squares, because the quantile is nearly linear in the root of the probability
    where it is small, and the least values decide.  The ends stand a little inside.
    """
    out = []
    for k in range(cells + 1):
        u = min(max(k, 0.25) / cells, 1 - 0.02 / cells) ** 2
        lo, hi = 0.0, 40.0
        for _ in range(60):
            x = (lo + hi) / 2
            if 1 - (1 + x) * math.exp(-x) < u:
                lo = x
            else:
                hi = x
        out.append((lo + hi) / 2)
    return out


def _cell(h: Column, shift: int) -> Column:
    """20 bits of a hash as a place in the table: the root of a uniform number."""
    u = (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFF)).cast("double") + 0.5) / float(1 << 20)
    return F.sqrt(u) * float(CELLS)


def _look(table: Column, place: Column) -> Column:
    k = place.cast("int")
    a = F.coalesce(F.get(table, k), F.lit(0.0))
    return a + (place - k) * (F.coalesce(F.get(table, k + 1), F.lit(0.0)) - a)


def add_samples(rows: DataFrame, first: Column, count: int, weights: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds, for ``count`` samples from number ``first``, one long for each weight column (given as logarithms).

    The upper half of the long orders the terms of a text, the lower names (term, t).
    One hash of (term, sample) gives all of its random numbers.
    """
    q = gamma_quantiles()
    plain, logs = F.array(*[F.lit(x) for x in q]), F.array(*[F.lit(math.log(x)) for x in q])
    rows = rows.withColumns({f"h{j}": F.xxhash64("term", first + j) for j in range(count)})
    rows = rows.withColumns({f"c{j}": _cell(F.col(f"h{j}"), 0) for j in range(count)} | {f"r{j}": _cell(F.col(f"h{j}"), 20) for j in range(count)})
    rows = rows.withColumns(
        {f"c{j}": _look(logs, F.col(f"c{j}")) for j in range(count)}
        | {f"r{j}": _look(plain, F.col(f"r{j}")) for j in range(count)}
        | {f"u{j}": (F.shiftrightunsigned(f"h{j}", 40).bitwiseAND(F.lit(0xFFFFF)).cast("double") + 0.5) / float(1 << 20) for j in range(count)}
    )
    rows = rows.withColumns({f"{w}_t{j}": F.floor(F.col(w) / F.col(f"r{j}") + F.col(f"u{j}")) for w in weights for j in range(count)})
    out = {}
    for w in weights:
        for j in range(count):
            t = F.col(f"{w}_t{j}")
            value = F.col(f"c{j}") - F.col(f"r{j}") * (t - F.col(f"u{j}") + 1)
            name = F.shiftrightunsigned(f"h{j}", 20).bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF))
            # the value lies between -60 and 4
            out[f"{w}_{j}"] = F.shiftleft(((value + 60) * float(1 << 24)).cast("long"), 32).bitwiseOR(name)
    return rows.withColumns(out), list(out)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty texts are alike, an empty one is like no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def as_text(a: Column) -> Column:
    """Eight hexadecimal digits of each sample, all that ``likeness`` compares; empty for an empty text."""
    return F.coalesce(F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), "")), F.lit(""))


def _place() -> Column:
    """A row's place in the order: null ids first, rows of one id by a hash of their texts."""
    return F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.xxhash64("text").alias("h"))


#: Hexadecimal digits of a hash that fit a long.
_DIGITS = 15


def _as_longs(hex64: Column) -> dict[str, Column]:
    """64 hexadecimal digits as longs, which aggregations hold in place, unlike text."""
    return {f"s{k}": F.conv(F.substring(hex64, k + 1, _DIGITS), 16, 10).cast("long") for k in range(0, 64, _DIGITS)}


def _from_longs() -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f"s{k}")), min(_DIGITS, 64 - k), "0") for k in range(0, 64, _DIGITS)])


_PLACE = "struct<k:boolean,i:bigint,h:bigint>"


def cut_points(docs: DataFrame, wanted: int, rows: int) -> list[tuple]:
    """Places that cut ``docs`` into about ``wanted`` buckets of equal bytes, from a sample by a hash of the row."""
    share = max(1, rows // (wanted * SAMPLE_ROWS))
    some = docs if share == 1 else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    got = sorted((r["p"]["k"], r["p"]["i"], r["p"]["h"], r["n"]) for r in some.select(_place().alias("p"), (F.octet_length("text") + 16).alias("n")).collect())
    total, upto, out = sum(r[3] for r in got), 0, []
    for r in got:
        if upto * wanted >= total * (len(out) + 1) and (not out or out[-1] != r[:3]):
            out.append(r[:3])
        upto += r[3]
    return out


def add_bucket(docs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``docs`` with bucket, the number of cuts at or before a row's place; looked up in two steps of about sqrt(cuts) each."""
    spark = docs.sparkSession
    step = max(1, math.isqrt(len(cuts)))
    below = lambda cuts_, p: F.size(F.filter(cuts_, lambda c: c <= p)).cast("long")
    cells = [(k // step, cuts[k + 1 : k + step]) for k in range(0, len(cuts), step)]
    tops = F.from_json(F.lit(json.dumps([dict(zip("kih", cuts[k])) for k in range(0, len(cuts), step)])), f"array<{_PLACE}>")
    cells = spark.createDataFrame([(-1, [])] + cells, f"cell long, inner array<{_PLACE}>")
    # a row below the first cut is in cell -1; the inner cuts of a cell follow its top one
    placed = docs.withColumn("place", _place()).withColumn("cell", below(tops, F.col("place")) - 1)
    placed = placed.join(small(cells, len(cuts) // step + 2), "cell")
    return placed.withColumn("bucket", F.when(F.col("cell") < 0, 0).otherwise(F.col("cell") * step + 1 + below(F.col("inner"), F.col("place")))).drop("cell", "inner")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt to buckets of neighbouring rows, and a number of partitions for them.

    Columns: bucket, copy (the first row of the next bucket, added at the end), place, doc_id, text.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    size = size or 0
    wanted = min(max(1, size // BUCKET_BYTES, min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), CUTS)
    placed = add_bucket(docs, cut_points(docs, wanted, n))
    heads = sorted((r["bucket"], tuple(r["first"])) for r in placed.groupBy("bucket").agg(F.min("place").alias("first")).collect())  # one for each bucket
    # the head of each bucket also ends the one before; the first one ends the last
    ends = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    ends = spark.createDataFrame(ends, f"place {_PLACE}, before long")
    copies = docs.withColumn("place", _place()).join(small(ends, len(heads)), "place").select("doc_id", "text", "place", F.col("before").alias("bucket"), F.lit(True).alias("copy"))
    parts = max(1, min(len(heads), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // PARTITION_BYTES)))
    return placed.withColumn("copy", F.lit(False)).unionByName(copies), parts


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), each beside its edited text and its successor.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty; its fingerprint is an empty
    string.  Rows are followed by the next in order of doc_id, a null doc_id first,
    rows of one doc_id by a hash of their texts, the last row by the first; a single
    row is followed by itself.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, parts = with_next(docs)
    order = Window.partitionBy("bucket").orderBy("copy", "place")
    rows = placed.repartition(parts, "bucket")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("copy"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(coalesce(after, ''), cast(floor(length(text) / 2) as int))")))
    rows = rows.select("bucket", "pos", "copy", "doc_id", n.cast("long").alias("n_chars"), F.array("text", edited).alias("texts"))
    # the key of a text's rows is two numbers; what else belongs to it is the same in all of them, and numbers too
    rows = rows.select("bucket", "pos", "copy", "doc_id", "n_chars", "texts", *[c.alias(n) for n, c in _as_longs(F.sha2(F.encode(F.col("texts")[1], "UTF-8"), 256)).items()])
    key, own = ["bucket", "pos"], ["copy", "doc_id", "n_chars", *[f"s{k}" for k in range(0, 64, _DIGITS)]]
    kept = [F.min(c).alias(c) for c in own]
    each = rows.select(*key, *own, F.posexplode("texts").alias("which", "text")).where("text is not null")
    words = each.select(*key, *own, "which", F.explode(F.split(lower_ascii(F.col("text")), BLANKS)).alias("word"))
    counted = words.groupBy(*key, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).agg(
        *kept, F.sum(F.when(F.col("which") == 0, 1).otherwise(0)).alias("w0"), F.sum(F.when(F.col("which") == 1, 1).otherwise(0)).alias("w1")
    )
    groups = samples // GROUP
    logged = counted.select(*key, *own, "term", *[F.when(F.col("term").isNotNull() & (F.col(w) > 0), F.ln(F.col(w).cast("double"))).alias(w) for w in ("w0", "w1")])
    dealt = logged.withColumn("g", F.explode(F.array(*[F.lit(k) for k in range(groups)])))
    valued, names = add_samples(dealt, F.col("g") * GROUP, GROUP, ["w0", "w1"])
    least = valued.groupBy(*key, "g").agg(*kept, *[F.min(c).alias(c) for c in names])
    parts_ = least.select(*key, *own, "g", *[F.when(F.col(f"{w}_0").isNotNull(), F.array(*[F.col(f"{w}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(GROUP)])).alias(w) for w in ("w0", "w1")])
    gathered = parts_.groupBy(*key).agg(*kept, F.sort_array(F.collect_list(F.struct("g", "w0", "w1"))).alias("all"))
    # concat is null when any of its parts is: all are, or none
    sigs = gathered.select(*key, *own, F.concat(*[F.col("all")[k]["w0"] for k in range(groups)]).alias("sig"), F.concat(*[F.col("all")[k]["w1"] for k in range(groups)]).alias("edited_sig"))
    after = Window.partitionBy("bucket").orderBy("pos")
    out = sigs.withColumn("next_sig", F.lead("sig").over(after)).where("not copy")
    return out.select(
        "doc_id",
        "n_chars",
        _from_longs().alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
