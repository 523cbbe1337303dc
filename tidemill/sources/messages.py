"""Reading message files and manifests, and their headers, bodies and attachments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from email import message_from_bytes, policy

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import address_list
from .work import ship

LARGEST = 50 << 20
# File endings by mime type.
EXTENSIONS = {"text/plain": ".txt", "text/html": ".html", "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx"}

MANIFEST = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("file_manifest", T.ArrayType(T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))),
    ]
)


def scan_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Message files of a folder (path, size, content), read as binary by the executors; one over 50 MB has no content, and is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{eml,msg}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path)
    fits = files.where(F.col("length") <= LARGEST).select("path", F.col("length").alias("size"), "content")
    return fits.unionByName(files.where(F.col("length") > LARGEST).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a JSON manifest; rows without batch id or files are dropped."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path).where("batch_id is not null")
    return m.select("batch_id", "source_type", F.posexplode("file_manifest").alias("position", "f")).select("batch_id", "source_type", "position", "f.*")


def _text(data: bytes, charset: str | None) -> str:
    """Bytes by their charset; by UTF-8 if that is none, unknown or wrong."""
    try:
        return data.decode(charset or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace")


def _leaf_parts(msg):
    for part in msg.walk():
        if not part.is_multipart():
            yield part


def _parse(batches: Iterable[pa.RecordBatch]):
    kinds = pa.schema(
        [(n, pa.string()) for n in ("path", "message_id", "subject", "from_address", "to_header", "cc_header", "bcc_header", "date_header", "in_reply_to", "references", "content_type", "charset", "body", "error")]
        + [("attachments", pa.list_(pa.struct([("filename", pa.string()), ("mimetype", pa.string()), ("size_bytes", pa.int64()), ("content_hash", pa.string()), ("content", pa.binary())])))]
    )
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            r = dict.fromkeys(kinds.names)
            r.update(path=path, attachments=[])
            if content is None:
                r["error"] = "OVERSIZED_EMAIL"
                rows.append(r)
                continue
            try:
                msg = message_from_bytes(content, policy=policy.compat32)
                head = lambda n: str(msg.get(n)) if msg.get(n) else None  # noqa: B023, E731
                r.update(
                    message_id=head("Message-ID"), subject=head("Subject") or "", from_address=head("From") or "", to_header=head("To"), cc_header=head("Cc"), bcc_header=head("Bcc"),
                    date_header=head("Date"), in_reply_to=head("In-Reply-To"), references=head("References"), content_type=msg.get_content_type(), charset=msg.get_content_charset() or "utf-8",
                )
                body = None
                for part in _leaf_parts(msg):
                    data = part.get_payload(decode=True) or b""
                    attached = part.get_content_disposition() == "attachment" or part.get_filename() or part.get("Content-ID")
                    if attached:
                        digest = hashlib.sha256(data).hexdigest()
                        name = part.get_filename() or f"attachment_{digest[:8]}{EXTENSIONS.get(part.get_content_type(), '.bin')}"
                        r["attachments"].append({"filename": name, "mimetype": part.get_content_type(), "size_bytes": len(data), "content_hash": digest, "content": data})
                    elif body is None and part.get_content_type() in ("text/plain", "text/html"):
                        body = _text(data, part.get_content_charset())
                r["body"] = body or ""
            except Exception as e:  # a bad message fails alone
                r["error"] = f"MALFORMED_MIME: {type(e).__name__}"
            rows.append(r)
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def parse_messages(files: DataFrame) -> DataFrame:
    """Headers, first text body and attachments of each file; one that cannot be parsed, or has no content, has an error instead."""
    ship(files.sparkSession)
    s = "string"
    cols = ", ".join(f"`{n}` {s}" for n in ("path", "message_id", "subject", "from_address", "to_header", "cc_header", "bcc_header", "date_header", "in_reply_to", "references", "content_type", "charset", "body", "error"))
    raw = files.select("path", "content").mapInArrow(_parse, cols + ", attachments array<struct<filename:string,mimetype:string,size_bytes:bigint,content_hash:string,content:binary>>")
    lists = {f"{k}_addresses": F.coalesce(address_list(F.col(f"{k}_header")), F.array().cast("array<string>")) for k in ("to", "cc", "bcc")}
    return raw.withColumns(lists).withColumn("date", parse_date(F.col("date_header"))).drop("to_header", "cc_header", "bcc_header")


def parse_date(c: Column, fallback: Column | None = None) -> Column:
    """RFC 2822 and ISO dates; anything else is the given fallback, null by default (never the clock)."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\(.*\)", ""), r"^[A-Za-z]{3}, *", ""))
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms], fallback if fallback is not None else F.lit(None).cast("timestamp"))


def domain(sender: Column) -> Column:
    return F.when(sender.contains("@"), F.substring_index(sender, "@", -1)).otherwise("unknown.domain")


def message_id(sender: Column, date_text: Column, subject: Column) -> Column:
    """A made-up message id: md5 of sender, date and subject, at the sender's domain."""
    return F.concat(F.lit("<"), F.md5(F.encode(F.concat(sender, date_text, subject), "UTF-8")), F.lit("@"), domain(sender), F.lit(">"))


def email_id(message: Column) -> Column:
    return F.concat(F.lit("email_"), F.substring(F.sha2(F.encode(message, "UTF-8"), 256), 1, 16))


def attachments_of(messages: DataFrame) -> DataFrame:
    return messages.select("path", "message_id", F.explode("attachments").alias("a")).select("path", "message_id", "a.*")
