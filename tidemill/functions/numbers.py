"""Quantiles, vectors and ranking measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exclusive_quantile(values: Column, parts: int, cut: int) -> Column:
    """The ``cut``-th of the cuts of a sorted array into ``parts`` equal groups, exclusive method; 0.0 below ``parts`` values."""
    v = F.sort_array(values)
    n = F.size(v)
    whole = F.floor(F.lit(cut) * (n + 1) / parts)
    j = F.greatest(F.lit(1), F.least(whole, (n - 1).cast("long"))).cast("int")
    delta = F.lit(cut) * (n + 1) - j * parts
    value = (F.element_at(v, j) * (parts - delta) + F.element_at(v, j + 1) * delta) / parts
    return F.when(n < parts, 0.0).otherwise(value)


def nearest_rank(values: Column, share: float) -> Column:
    """Element number floor(n * share), from 0, of a sorted array; 0.0 for an empty one."""
    v = F.sort_array(values)
    return F.when(F.size(v) == 0, 0.0).otherwise(F.element_at(v, (F.floor(F.size(v) * share) + 1).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hit_at(scores: Column, k: int, relevant: float = 0.5) -> Column:
    """Share of relevant scores among the first k, or all if there are fewer."""
    top = F.slice(scores, 1, k)
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.size(F.filter(top, lambda x: x > relevant)) / F.least(F.lit(k), F.size(scores)))


def reciprocal_rank(scores: Column, relevant: float = 0.5) -> Column:
    at = F.array_position(F.transform(scores, lambda x: x > relevant), F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def _gain(scores: Column, log2: bool = False) -> Column:
    gain = F.transform(scores, lambda x, i: x / (F.log2(i + 2) if log2 else (i + 1)))
    return F.aggregate(gain, F.lit(0.0), lambda s, x: s + x)


def ndcg_linear(scores: Column, k: int, log2: bool = False) -> Column:
    """Discounted gain with discount 1/rank over that of the same k scores in descending order."""
    top = F.slice(scores, 1, k)
    best = _gain(F.sort_array(top, asc=False), log2)
    return F.when(best > 0, _gain(top, log2) / best).otherwise(0.0)


def precision_recall_f1(scores: Column, k: int, relevant: float = 0.5) -> tuple[Column, Column, Column]:
    found = F.size(F.filter(F.slice(scores, 1, k), lambda x: x > relevant))
    total = F.size(F.filter(scores, lambda x: x > relevant))
    p = found / F.lit(float(k))
    r = F.when(total > 0, found / total).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return p, r, f1
