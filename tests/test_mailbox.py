"""Mailboxes against the standard library; odd message files."""

import mailbox as standard
import uuid

from pyspark.sql import functions as F

from tidemill.sources import mailbox, messages
from tidemill.sources.work import folder
from tidemill.streaming import resume


def box(path, n, first=0):
    b = standard.mbox(path)
    for i in range(first, first + n):
        m = standard.mboxMessage(f"Message-ID: <m{i}@x.org>\nFrom: a{i}@x.org\nTo: b@x.org\nSubject: note {i}\n\nFrom here on\n>From there\ntext {i} é\n".encode())
        m.set_from(f"a{i}@x.org Mon Jan  1 00:00:00 2024")
        b.add(m)
    b.close()


def test_messages_like_the_standard_library(spark, tmp_path):
    box(tmp_path / "one.mbox", 5)
    box(tmp_path / "two.mbox", 3, 10)
    (tmp_path / "none.mbox").write_text("")
    (tmp_path / "other.txt").write_text("From x\n\nno\n")
    found = mailbox.read(spark, str(tmp_path))
    got = {r.message_id: r for r in messages.parse_messages(found).collect()}
    assert sorted(got) == sorted(f"<m{i}@x.org>" for i in [*range(5), *range(10, 13)])
    assert got["<m3@x.org>"].subject == "note 3" and "text 3 é" in got["<m3@x.org>"].body and got["<m3@x.org>"].body.startswith("From here on\n")
    assert {r.sender for r in found.collect()} == {f"a{i}@x.org" for i in [*range(5), *range(10, 13)]}


def test_a_mailbox_is_split(spark, tmp_path):
    """A file of many messages is read by several tasks, and each message once."""
    box(tmp_path / "big.mbox", 2000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = mailbox.read(spark, str(tmp_path))
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert messages.parse_messages(found).select("message_id").distinct().count() == found.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stream_reads_the_same(spark, tmp_path):
    box(tmp_path / "one.mbox", 4)
    name = f"mail-{uuid.uuid4().hex}"
    stream = lambda: mailbox.read_stream(spark, str(tmp_path), files=1)
    resume.advance(name, stream())
    box(tmp_path / "two.mbox", 3, 10)
    resume.advance(name, stream())
    got = resume.written(spark, name, stream().schema)
    key = lambda df: sorted((r.sender, bytes(r.content)) for r in df.collect())
    assert key(got) == key(mailbox.read(spark, str(tmp_path))) and got.count() == 7


def test_written_mailboxes_are_read_back(spark):
    at = f"{folder(spark)}/mail-{uuid.uuid4().hex}"
    rows = [("a@x", "Subject: one\n\nFrom me\n\nend"), ("b@x", "Subject: two\n\n>From you"), ("c@x", "Subject: three\n\n")]
    mail = spark.createDataFrame(rows, "sender string, content string").withColumn("date", F.lit("2024-01-01").cast("timestamp")).coalesce(1)
    mailbox.write(mail, at, "sender", "date", "content")
    got = sorted((r.sender, bytes(r.content).decode()) for r in mailbox.read(spark, at, "*.txt").collect())
    assert [(s, c.rstrip("\n")) for s, c in got] == [(s, c.rstrip("\n")) for s, c in rows]


def test_odd_message_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <a>\nContent-Type: text/plain; charset=no-such-charset\n\nr\xc3\xa9sum\xc3\xa9")
    (tmp_path / "b.eml").write_bytes(b"x" * 3000)
    (tmp_path / "c.eml").write_bytes(b"\n")
    monkeypatch.setattr(messages, "LARGEST", 1000)
    got = {r.path.rsplit("/", 1)[1]: r for r in messages.parse_messages(messages.scan_files(spark, str(tmp_path))).collect()}
    assert got["a.eml"].body == "résumé" and got["a.eml"].error is None
    assert got["b.eml"].error == "OVERSIZED_EMAIL" and got["c.eml"].error is None
