"""Conversation threads: ids, positions, consistency, and the ordered assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_subject
from ..sources.work import cut


def thread_id(message_id: Column, subject: Column) -> Column:
    short = lambda c: F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 16)
    return F.when(F.length(message_id) > 0, F.concat(F.lit("thread_"), short(message_id))).otherwise(F.concat(F.lit("thread_subj_"), short(normalize_subject(subject))))


def references(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \t\n\r\f\x0b]+"), lambda x: F.length(x) > 0)


def position(subject: Column, in_reply_to: Column, refs: Column) -> Column:
    """is_reply, is_forward and level of a message."""
    reply = F.coalesce(F.length(in_reply_to) > 0, F.lit(False))
    forward = F.coalesce(F.lower(subject).rlike("^(fwd:|fw:|forward:)"), F.lit(False))
    return F.struct(reply.alias("is_reply"), forward.alias("is_forward"), F.when(F.size(refs) > 0, F.size(refs)).when(reply, 1).otherwise(0).alias("level"))


def consistency(message_id: Column, in_reply_to: Column, refs: Column, date: Column, now: Column) -> Column:
    """Problems of a message's thread headers."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(message_id), F.lit(0)) == 0, "missing message id"),
            F.when((F.length(in_reply_to) > 0) & ~F.array_contains(refs, in_reply_to), "reply not in references"),
            F.when(F.array_contains(refs, message_id), "self in references"),
            F.when(date > now, "date in the future"),
        )
    )


def thread_stats(messages: DataFrame, thread: str = "thread_id", group: list[str] | None = None) -> DataFrame:
    """By group: threads, messages, mean and largest depth and breadth."""
    group = group or []
    per = messages.groupBy(*group, thread).agg(F.count("*").alias("breadth"), F.when(F.max(F.col("is_reply").cast("int")) > 0, 2).otherwise(1).alias("depth"))
    return per.groupBy(*group).agg(
        F.count("*").alias("threads"), F.sum("breadth").alias("messages"), F.avg("depth").alias("avg_depth"), F.max("depth").alias("max_depth"), F.avg("breadth").alias("avg_breadth"), F.max("breadth").alias("max_breadth")
    )


def assign(messages: DataFrame) -> DataFrame:
    """Threads by first hit in arrival order: tenant_id, seq, message_id, thread_root; one row per row.

    Columns in: tenant_id, seq, message_id, subject, in_reply_to, refs.  A message
    goes to the thread of its own id if that came before, else of the one it replies
    to, else of the first reference that is known by then; else to the thread that was
    founded under its normalized subject; else it founds one.  Equal ``seq`` are
    ordered by id.  A message without a subject is not looked up by it, and one
    without an id, named ``seq-`` and its number here, is linked by nobody.

    What a message finds is an earlier message, whatever thread that is in, and a
    message that finds none joins the first such of its subject.  So every message
    points to an earlier one or to itself, and pointers are followed in doubling
    steps: as many rounds as the depth of the longest chain has binary digits, over
    the messages that are not there yet.  No task holds a tenant.
    """
    spark = messages.sparkSession
    text = lambda c: F.length(c) > 0
    named = F.coalesce(text(F.col("message_id")), F.lit(False))
    rows = messages.select(
        F.to_json(F.struct("tenant_id")).alias("t"), "tenant_id", "seq", "message_id", named.alias("named"), F.when(named, F.col("message_id")).otherwise(F.concat(F.lit("seq-"), F.col("seq").cast("string"))).alias("node"),
        "subject", F.filter(F.concat(F.array("in_reply_to"), F.coalesce("refs", F.array().cast("array<string>"))), text).alias("looks"),
    )
    came = F.struct("seq", "node")
    heads = cut(rows.groupBy("t", "node").agg(F.min_by(F.struct("seq", "named", "subject", "looks"), came).alias("h")).select("t", "node", "h.*"), spark)
    ids = heads.where("named").select("t", F.col("node").alias("target"), F.struct("seq", "node").alias("earlier"))
    looks = heads.select("t", "node", came.alias("came"), F.posexplode("looks").alias("k", "target"))
    links = looks.join(ids, ["t", "target"]).where(F.col("earlier") < F.col("came")).groupBy("t", "node").agg(F.min_by("target", "k").alias("up"))
    alone = heads.join(links, ["t", "node"], "left_anti").withColumn("topic", F.when(text(F.col("subject")), normalize_subject(F.col("subject"))))
    founders = alone.where("topic is not null").groupBy("t", "topic").agg(F.min_by("node", came).alias("up"))
    own = alone.where("topic is null").select("t", "node", F.col("node").alias("up"))
    pointers = links.unionByName(alone.join(founders, ["t", "topic"]).select("t", "node", "up")).unionByName(own)
    state = cut(pointers.withColumn("settled", F.col("up") == F.col("node")), spark)
    while not (moving := state.where("not settled")).isEmpty():
        steps = state.select("t", F.col("node").alias("up"), F.col("up").alias("next"), F.col("settled").alias("there"))
        moved = moving.select("t", "node", "up").join(steps, ["t", "up"]).select("t", "node", F.col("next").alias("up"), F.col("there").alias("settled"))
        state = cut(state.where("settled").unionByName(moved), spark)
    return rows.join(state, ["t", "node"]).select("tenant_id", "seq", "message_id", F.col("up").alias("thread_root"))


def thread_info(assigned: DataFrame, messages: DataFrame) -> DataFrame:
    """By thread: subject (normalized, of the founder), messages, first and last date, depth (2 once there is a reply), breadth.

    ``messages`` has tenant_id, seq, message_id and date; with subject and
    in_reply_to also the subject is told and a reply known.
    """
    have = [c for c in ("date", "subject", "in_reply_to") if c in messages.columns]
    same = F.col("a.tenant_id").eqNullSafe(F.col("m.tenant_id")) & (F.col("a.seq") == F.col("m.seq")) & F.col("a.message_id").eqNullSafe(F.col("m.message_id"))
    both = assigned.alias("a").join(messages.alias("m"), same).select("a.*", *[f"m.{c}" for c in have])
    came = F.struct("seq", "message_id")
    cols = [F.count("*").alias("email_count"), F.min_by("date", came).alias("first_date"), F.max_by("date", came).alias("last_date")]
    if "subject" in have:
        cols.append(normalize_subject(F.min_by("subject", came)).alias("subject_norm"))
    replies = F.col("in_reply_to").isNotNull() & (F.length("in_reply_to") > 0) if "in_reply_to" in have else F.lit(True)
    later = F.when(replies & (F.coalesce(F.col("message_id"), F.lit("")) != F.col("thread_root")), 1)
    g = both.groupBy("tenant_id", "thread_root").agg(*cols, F.count(later).alias("_replies"))
    return g.withColumn("depth", F.when(F.col("_replies") > 0, 2).otherwise(1)).withColumn("breadth", F.col("email_count")).drop("_replies")


def threads_by_subject(info: DataFrame, subjects: DataFrame) -> DataFrame:
    """Threads whose founder's subject reads like one of ``subjects`` (tenant_id, subject)."""
    asked = subjects.select("tenant_id", normalize_subject(F.col("subject")).alias("subject_norm")).distinct()
    return info.join(asked, ["tenant_id", "subject_norm"], "left_semi")


def thread_by_message(info: DataFrame, assigned: DataFrame, asked: DataFrame) -> DataFrame:
    """The thread of each of ``asked`` (tenant_id, message_id); unknown ones are left out."""
    where = assigned.select("tenant_id", "message_id", "thread_root").distinct()
    return asked.select("tenant_id", "message_id").distinct().join(where, ["tenant_id", "message_id"]).join(info, ["tenant_id", "thread_root"])


def drop_threads(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("thread_id").distinct(), "thread_id", "left_anti")
