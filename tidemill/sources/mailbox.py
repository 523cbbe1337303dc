"""Mailbox files (mbox) as a batch and as a stream of messages.

A mailbox holds messages one after another, each behind a line that begins with
``From `` and a sender.  Spark's text source reads with that beginning as the
separator, so a large mailbox is split by byte ranges like any text file, a
message stays whole, and any store will do; as a stream it keeps track of the
files it has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\nFrom "


def _messages(records: DataFrame) -> DataFrame:
    """(path, sender, content) of records between separators; content is the message's own bytes."""
    raw = F.regexp_replace(F.col("value"), "^From ", "")  # the first of a file
    line = F.regexp_extract(raw, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(raw, r"^[^\r\n]*(\r?\n|$)", ""), r"\r?\n?\z", "")
    # a line of a message that would look like a separator was written with a > before it
    body = F.regexp_replace(body, "(?m)^>(>*From )", "$1")
    found = records.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract(line, r"^(\S*)", 1).alias("sender"), body.cast("binary").alias("content"))
    return found.where(F.length("content") > 0)


def read(spark: SparkSession, path: str, glob: str = "*.mbox") -> DataFrame:
    """Messages of all mailboxes under ``path``: path, sender, content.  An empty mailbox has none."""
    return _messages(spark.read.option("lineSep", SEPARATOR).option("pathGlobFilter", glob).text(path))


def read_stream(spark: SparkSession, path: str, glob: str = "*.mbox", files: int | None = None) -> DataFrame:
    """The same of the mailboxes that arrive under ``path``, ``files`` to a micro-batch at most."""
    reader = spark.readStream.option("lineSep", SEPARATOR).option("pathGlobFilter", glob)
    return _messages((reader.option("maxFilesPerTrigger", files) if files else reader).text(path))


def line(sender: Column, date: Column, content: Column) -> Column:
    """A message as it stands in a mailbox, without the separator's line break."""
    return F.concat(F.lit("From "), sender, F.lit(" "), F.date_format(date, "EEE MMM dd HH:mm:ss yyyy"), F.lit("\n"), F.regexp_replace(content, "(?m)^(>*From )", ">$1"))


def write(messages: DataFrame, path: str, sender: str, date: str, content: str) -> None:
    """Messages as mailboxes, one to a partition, in the folder ``path``."""
    messages.select(line(F.col(sender), F.col(date), F.col(content)).alias("value")).write.option("lineSep", "\n").text(path)
