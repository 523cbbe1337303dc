"""Object paths, their validity, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def object_path(tenant: Column, sent: Column, thread: Column, email: Column, kind: Column, name: Column) -> Column:
    """tenant/yyyy/MM/dd/thread/email/kind/name."""
    return F.concat_ws("/", tenant, F.date_format(sent, "yyyy/MM/dd"), thread, email, kind, safe_name(name))


def attachment_path(tenant: Column, sent: Column, thread: Column, email: Column, index: Column, name: Column) -> Column:
    return F.concat_ws("/", tenant, F.date_format(sent, "yyyy/MM/dd"), thread, email, F.lit("att"), F.concat_ws("_", index.cast("string"), safe_name(name)))


def is_valid_path(c: Column) -> Column:
    return F.coalesce(c.rlike("^(tenant|dev)-[^/]+/[0-9]{4}/[0-9]{2}/[0-9]{2}/.+") & ~c.contains(".."), F.lit(False))


def parse_path(c: Column) -> Column:
    p = F.split(c, "/")
    at = lambda i: F.get(p, F.lit(i))
    return F.struct(at(0).alias("tenant"), F.concat_ws("/", at(1), at(2), at(3)).alias("date"), at(4).alias("thread"), at(5).alias("email"), at(6).alias("kind"), F.element_at(p, -1).alias("filename"))


def content_metadata(c: Column) -> Column:
    return F.struct(F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"), F.octet_length(c).alias("size"))


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "append") -> None:
    """Rows in folders by tenant (and more), so that a tenant's reads are pruned to its own."""
    df.write.format(fmt).mode(mode).partitionBy(*by).save(path)


def export(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in ("json", "csv"):
        raise ValueError("json or csv")
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if fmt == "csv" else w.json)(path)
