"""Values at given ranks of each group, without one task seeing a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import cut

#: From a group's number of values: the first rank (from 1), the weight of it, and that of the next.
Rank = Callable[[Column], tuple[Column, Column, Column]]


def nearest(share: float) -> Rank:
    """Element number floor(n * share), from 0."""
    return lambda n: (F.floor(n * share) + 1, F.lit(1.0), F.lit(0.0))


def exclusive(parts: int, number: int) -> Rank:
    """The ``number``-th cut into ``parts`` equal groups, exclusive method; nothing below ``parts`` values."""

    def rank(n: Column) -> tuple[Column, Column, Column]:
        j = F.greatest(F.lit(1), F.least(F.floor(F.lit(number) * (n + 1) / parts), n - 1))
        delta = F.lit(number) * (n + 1) - j * parts
        return F.when(n >= parts, j), (parts - delta) / parts, delta / parts

    return rank


def linear(share: float) -> Rank:
    """Between the elements around (n - 1) * share, in proportion."""

    def rank(n: Column) -> tuple[Column, Column, Column]:
        at = (n - 1) * F.lit(share)
        return F.floor(at) + 1, 1 - (at - F.floor(at)), at - F.floor(at)

    return rank


def values_at(rows: DataFrame, group: list[str], col: str, wanted: dict[str, Rank]) -> DataFrame:
    """By group: n (values that are not null) and, for each name, its value; null if there is none.

    Equal values are counted first, on the map side too, so a value that a third of
    all rows share is one row.  Different values are dealt to slices in order of
    (group, value), so a group may span many; running sums within a slice and over
    the slices before give each value the ranks it holds.
    """
    spark = rows.sparkSession
    v = rows.select(*group, F.col(col).alias("_v")).where(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    v = cut(v.repartitionByRange(*group, "_v").withColumn("_slice", F.spark_partition_id()), spark)  # a slice's bounds come from a sample
    counts = v.groupBy(*group, "_slice").agg(F.sum("_c").alias("_c"))
    by = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(by.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*group, "_slice", before.alias("_before"), F.sum("_c").over(by).alias("n"))
    same = F.col("d._slice") == F.col("s._slice")
    for c in group:
        same &= F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    upto = F.sum("_c").over(Window.partitionBy(*group, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = v.withColumn("_k", upto).alias("d").join(starts.alias("s"), same)
    last = F.col("_before") + F.col("_k")
    at = at.select(*[F.col(f"d.{c}") for c in group], "n", "_v", (last - F.col("d._c")).alias("_from"), last.alias("_to"))
    ranks = {name: rank(F.col("n")) for name, rank in wanted.items()}
    holds = lambda j: (F.col("_from") < j) & (j <= F.col("_to"))
    hit = F.lit(False)
    for j, _, _ in ranks.values():
        hit |= F.coalesce(holds(j) | holds(j + 1), F.lit(False))
    # at most two values a name of each group go on; the first is kept for groups without any
    few = at.where(hit | (F.col("_from") == 0))
    pick = lambda j: F.max(F.when(holds(j), F.col("_v")))
    cols = []
    for name, (j, w1, w2) in ranks.items():
        cols.append((pick(j) * F.first(w1) + F.coalesce(pick(j + 1) * F.first(w2), F.lit(0.0))).alias(name))
    return few.groupBy(*group, "n").agg(*cols)
