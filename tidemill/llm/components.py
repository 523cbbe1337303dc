"""Connected components of a link table, by alternating large and small stars.

Everything is a grouped minimum and an equi-join; a hub with very many links is
reduced on the map side by the minimum and split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (u > v); returns edges of the same kind."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(edges: DataFrame, work: Work, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without a link are absent.

    ``edges`` has long columns a and b, in any direction; loops and nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = work.table(e, "edges")
    sign = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    seen = e.select(sign.alias("s")).first()["s"]
    for _ in range(rounds):
        if not seen["n"]:
            break
        nxt = work.table(_star(_star(e, True), False), "edges")
        work.drop(e)
        e = nxt
        now = e.select(sign.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
