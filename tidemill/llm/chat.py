"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is rendered.

A conversation that is logged again and again while it grows leaves snapshots
that are prefixes of one another.  Its turns, in order of (turn, role, text), are
hashed; the running exclusive-or of those hashes, with their number, names every
prefix.  A conversation is dropped when its whole is also a strict prefix of
another; of equal conversations the smallest conv_id stays.

Texts move twice: when the turns of a conversation come together (in parts of
neighbouring turn numbers, which are rendered and hashed in one place), and when
the parts of a conversation that stays are joined.  Everything between moves
hashes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work

#: Turn numbers that are put in order, hashed and rendered together.
PART = 256
_HASHES = ("h1", "h2")


def parts(conversations: DataFrame) -> DataFrame:
    """One row per conversation and part: conv_id, part, n, text (rendered), running (n, h1, h2 of every prefix of the part)."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn")]
    cols += [F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    t = conversations.select(*cols).withColumn("part", F.floor(F.col("turn") / PART))
    rows = F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text"))))
    t = t.groupBy("conv_id", "part").agg(rows.alias("rows"))
    clean = lambda x: F.replace(x, F.lit("<|im_"), F.lit("< |im_"))
    line = lambda r: F.concat(F.lit("<|im_start|>"), r["role"], F.lit("\n"), clean(r["text"]), F.lit("<|im_end|>\n"))
    named = lambda r: F.struct(*[F.xxhash64(r["turn"], r["role"], r["text"], F.lit(k)).alias(h) for k, h in enumerate(_HASHES, 1)])
    last = lambda a: F.element_at(a, -1)
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(h) for h in _HASHES])
    step = lambda a, r: F.concat(a, F.array(F.struct((last(a)["n"] + 1).alias("n"), *[last(a)[h].bitwiseXOR(r[h]).alias(h) for h in _HASHES])))
    running = F.slice(F.aggregate(F.transform("rows", named), F.array(zero), step), 2, F.size("rows"))
    return t.select("conv_id", "part", F.size("rows").alias("n"), F.array_join(F.transform("rows", line), "").alias("text"), running.alias("running"))


def maximal(parts: DataFrame) -> DataFrame:
    """The conv_id of every conversation that stays, by ``parts``."""
    ends = parts.select("conv_id", "part", *[F.element_at("running", -1)[c].alias(c) for c in ("n", *_HASHES)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bn"), *[F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"b{h}") for h in _HASHES])
    a, b = parts.select("conv_id", "part", "running").alias("a"), bases.alias("b")
    each = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))).select("bn", *[f"b{h}" for h in _HASHES], F.explode("running").alias("r"))
    name = ["n", *_HASHES]
    prefixes = each.select((F.col("bn") + F.col("r.n")).alias("n"), *[F.col(f"b{h}").bitwiseXOR(F.col(f"r.{h}")).alias(h) for h in _HASHES])
    whole = ends.groupBy("conv_id").agg(F.sum("n").alias("n"), *[F.bit_xor(h).alias(h) for h in _HASHES])
    same = whole.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("whole"))
    seen = prefixes.groupBy(*name).agg(F.count("*").alias("seen"))
    # what is a prefix more often than it is a whole belongs to a longer conversation
    return same.join(seen, name).where("seen = whole").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text for each conversation that stays, in ChatML.

    A turn is ``<|im_start|>role`` line break, text, ``<|im_end|>`` line break;
    those marks inside a text get a blank after ``<``.  Turns are ordered by (turn,
    role, text), and so are those that share a number: each of them ends a prefix.
    Rows that repeat count once; a null turn comes first, a null role is
    ``unknown``, a null text is empty, rows without conv_id are one conversation,
    which gives way to an equal one that has an id.  An empty table gives an empty
    result; other columns are ignored.
    """
    table = Work(conversations.sparkSession, "chat").table(parts(conversations), "parts")
    kept = maximal(table).withColumnRenamed("conv_id", "kept")
    stay = table.select("conv_id", "part", "n", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return stay.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), whole.alias("text"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
c AS (SELECT conv_id, list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role, text) AS l, count(*) AS n FROM t GROUP BY conv_id),
kept AS (
  SELECT a.conv_id FROM c a
  WHERE NOT EXISTS (
    SELECT 1 FROM c b
    WHERE b.conv_id <> a.conv_id AND b.l[1] = a.l[1] AND list_slice(b.l, 1, a.n) = a.l
      AND (b.n > a.n OR b.conv_id < a.conv_id)))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
GROUP BY conv_id
"""
