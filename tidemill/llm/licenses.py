"""License scans: phrases, and an exact set-similarity join with notice templates, in DataFrame functions only.

Every run of ``WINDOW`` consecutive words of a text, wherever it starts, is a
block.  A block matches a template when it holds at least ``THRESHOLD`` of the
template's distinct words.  The join goes over postings:

* the words of all templates are ordered by how many documents hold them, rarest
  first;
* prefix filter: a template is a candidate for a document that holds one of its
  first ``|T| - need + 1`` words in that order;
* length filter: the document must hold ``need`` of its words at all;
* positional filter: places of template words stay only where the rarest template
  word within a block's reach leaves room for ``need``;
* the blocks that begin at the remaining places are counted exactly.

The best block of a text begins at a template word (moving a block's start to its
first template word loses none), so blocks at those places decide for all starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, small
from .fingerprint import lower_ascii

WINDOW, THRESHOLD = 64, 0.85

# The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening sentences of public license notices, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Everything that is not in a word: \x00-\x2F, \x3A-\x60, \x7B-\x7F, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, each with one blank before and one after; empty without words."""
    plain = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAPS, "  "))
    return F.when(F.length(plain) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _count(text: Column, phrase: Column | str) -> Column:
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.floor((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def _pattern(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def template_postings(held: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(word, t, label, n, need, rank): the words of each template, rank 1 for the one that fewest rows of ``held`` (words) hold.

    Counting is over all documents; its result has a row for each template word.
    """
    spark = held.sparkSession
    rows = []
    for t, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        rows += [(w, t, label, len(words), math.ceil(threshold * len(words) - 1e-9)) for w in words]
    table = spark.createDataFrame(rows, "word string, t int, label string, n int, need int")
    count = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    order = Window.partitionBy("t").orderBy(F.coalesce("docs", F.lit(0)), "word")
    return table.join(count, "word", "left").select("word", "t", "label", "n", "need", F.row_number().over(order).alias("rank"))


def _scanned(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """One pass over the texts: the phrases' columns, held (template words of the document) and, where enough are held, words."""
    docs = docs.select("doc_id", spaced(F.col("text")).alias("s"))
    split = F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(s, 2, length(s) - 2)"), "  "))
    marks = {p: _pattern(p) for p in PHRASES}
    hit = {p: F.col("s").contains(m) for p, m in marks.items()}
    anyhit = None
    for h in hit.values():
        anyhit = h if anyhit is None else anyhit | h
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    first, last, total = [], [], None
    for p, m in marks.items():
        at = F.locate(m, F.col("s"))
        ahead = spaces(F.substr(F.col("s"), F.lit(1), at - 1)) / 2
        first.append(F.when(hit[p], ahead.cast("long")))
        back = F.locate(m[::-1], F.reverse("s"))
        behind = spaces(F.substr(F.reverse("s"), F.lit(1), back - 1)) / 2
        last.append(F.when(hit[p], F.col("n_words") - behind.cast("long") - len(p.split())))
        n = F.when(hit[p], _count(F.col("s"), m)).otherwise(F.lit(0).cast("long"))
        total = n if total is None else total + n
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(hit[p], F.lit(x)) for p, x in PHRASES.items()]))))
    vocab = F.array(*[F.lit(w) for w in vocabulary(templates)])
    least = min(math.ceil(threshold * len(set(text.split())) - 1e-9) for _, text in templates)
    out = docs.withColumn("n_words", F.size(split).cast("long")).withColumn("words", split)
    out = out.withColumn("held", F.array_intersect("words", vocab))
    return out.select(
        "doc_id",
        "n_words",
        F.when(anyhit, total).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(anyhit, F.least(*first)).alias("first_word"),
        F.when(anyhit, F.greatest(*last)).alias("last_word"),
        F.when(anyhit, base).otherwise(F.array().cast("array<string>")).alias("base"),
        "held",
        F.when(F.size("held") >= least, F.col("words")).alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )


def block_matches(scanned: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(row, label, start, containment): the blocks that begin at a template word and reach the threshold.

    ``scanned`` has row, held (distinct template words) and words (null where too few are held).
    """
    work = Work(scanned.sparkSession, "licenses")
    post = work.table(template_postings(scanned, templates, threshold), "postings")
    post = small(post, post.count())
    some = scanned.where("words is not null")
    near = some.select("row", "held", F.explode("held").alias("word")).join(post.where("rank <= n - need + 1"), "word").select("row", "t").distinct()
    # the length filter, on the words that the document holds
    enough = some.select("row", F.explode("held").alias("word")).join(post, "word").groupBy("row", "t").agg(F.count("*").alias("c"), F.first("need").alias("need")).where("c >= need")
    pairs = work.table(near.join(enough.select("row", "t"), ["row", "t"]), "pairs")
    n = pairs.count()
    # only the texts of candidates are cut into postings
    some = some.select("row", "words").join(small(pairs.select("row").distinct(), n), "row", "left_semi")
    places = some.select("row", F.posexplode("words").alias("pos", "word")).join(post, "word").join(small(pairs, n), ["row", "t"])
    order = Window.partitionBy("row", "t").orderBy("pos")
    places = places.withColumn("rarest", F.min("rank").over(order.rangeBetween(1 - window, window - 1))).where("n - rarest + 1 >= need")
    counted = places.withColumn("c", F.size(F.collect_set("rank").over(order.rangeBetween(0, window - 1)))).where("c >= need")
    return counted.select("row", "label", F.col("pos").cast("long").alias("start"), (F.col("c") / F.col("n")).alias("containment"))


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    doc_id, n_words, n_base (places of a phrase), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (distinct, sorted,
    comma-joined), score (1 with a phrase, else the best containment of any block
    that matches a template, else 0), matches (label, containment and first start of
    the best block of each label).  A null or empty text has no words and no labels.
    Repeated rows are returned as often; other columns are ignored.
    """
    scanned = Work(docs.sparkSession, "licenses").table(_scanned(docs, templates, threshold), "scanned")
    best = block_matches(scanned, templates, threshold).groupBy("row", "label").agg(F.max(F.struct("containment", (-F.col("start")).alias("m"))).alias("b"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", F.col("b.containment").alias("containment"), (-F.col("b.m")).alias("start")))).alias("matches"))
    none = F.array().cast("array<struct<label:string,containment:double,start:bigint>>")
    out = scanned.drop("words", "held").join(found, "row", "left").withColumn("matches", F.coalesce("matches", none))
    top = F.coalesce(F.array_max(F.transform("matches", lambda b: b["containment"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda b: b["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(top).alias("score"),
        "matches",
    )
