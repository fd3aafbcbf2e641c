"""License scans by diagonal voting, with DataFrame functions alone.

Templates are word sequences: short names that must stand as they are, and notices that may be cut or altered. All rolling
word grams of all texts meet the templates' grams in a join on the hash of their first two words; a gram at word w that
stands at position t of a template votes for the diagonal w - t, the place at which the template would begin. A name is
found where all of its grams vote for one diagonal. A notice's neighbouring diagonals (words added or left out shift the rest) are merged, and the
span is verified: its grams, compared word by word, have to cover enough of the template within a span not much longer.

Texts are read in place, twice, and never shuffled; what is shuffled are the grams that templates have too. The templates'
grams are broadcast: their number is fixed by TEMPLATES and checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Words are runs of ASCII letters, digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of a gram, in names and in notices.
NAME_GRAM, NOTICE_GRAM = 2, 4
#: A notice is found where so much of its words is covered, by a span of at most so many times its words; diagonals merge
#: that lie at most so many words apart.
COVER, STRETCH, NEAR = 0.5, 1.5, 8
#: Words of all templates, whose grams are broadcast, at most.
MOST_GRAMS = 100_000

#: Names of licenses and their labels; the first three are the contract's.
NAMES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("isc license", "isc"),
    ("bsd license", "bsd"),
    ("creative commons", "cc"),
    ("licensed under cc by", "cc"),
    ("licensed under cc0", "cc"),
    ("all rights reserved", "reserved"),
]
BASE = 3
#: Notices that licenses ask to be kept, and their labels.
NOTICES = [
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]


def folded(text: Column | str) -> Column:
    """The text in lower case, once for all its words. Template words are ASCII, and the one letter beyond ASCII whose
    lower case is not, the Kelvin sign, is put out of the way first, so that no other word becomes one of theirs."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def templates(spark: SparkSession, names: list[tuple[str, str]] = NAMES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(template, label, words, gram): names first, numbered from 0; words in lower case."""
    if any(len(name.split()) < NAME_GRAM for name, _ in names):
        raise ValueError(f"a name has {NAME_GRAM} words or more")
    rows = [(i, label, text, NAME_GRAM) for i, (text, label) in enumerate(names)]
    rows += [(len(names) + i, label, text, NOTICE_GRAM) for i, (label, text) in enumerate(notices)]
    each = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(k).alias("gram")) for i, label, text, k in rows])
    table = spark.range(1).select(F.inline(each))
    return table.select("template", "label", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"), "gram")


def grams(table: DataFrame) -> DataFrame:
    """(hash, at): the grams of all templates by the hash of their first two words, with their template and place."""
    at = table.select("template", F.size("words").alias("n"), "words", "gram", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("gram"))).alias("t"))
    said = F.slice("words", F.col("t") + 1, F.col("gram"))
    rows = at.select("template", "n", "t", said.alias("said"))
    rows = rows.select(F.xxhash64(F.get("said", F.lit(0)), F.get("said", F.lit(1))).alias("hash"), F.struct("template", "n", "t", "said").alias("place"))
    return rows.groupBy("hash").agg(F.collect_list("place").alias("at"))


def document_key(text: str = "text") -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc, key, template, n, t, w): word w of a document begins the gram that stands at word t of a template."""
    known = grams(table)
    if table.agg(F.sum(F.size("words"))).first()[0] > MOST_GRAMS:
        raise ValueError(f"templates have more than {MOST_GRAMS} words")
    rows = docs.select(F.col("doc_id").alias("doc"), document_key().alias("key"), F.regexp_extract_all(folded("text"), F.lit(WORD), F.lit(0)).alias("words"))
    # One pass: every word's place with the word that follows it, in the task that read the text.
    at = rows.select("doc", "key", "words", F.posexplode("words").alias("w", "word"))
    at = at.withColumn("hash", F.xxhash64("word", F.get("words", F.col("w") + 1)))
    hit = at.join(F.broadcast(known), "hash").select("doc", "key", "w", F.slice("words", F.col("w") + 1, NOTICE_GRAM).alias("ahead"), F.explode("at").alias("p"))
    hit = hit.where(F.slice("ahead", 1, F.size("p.said")) == F.col("p.said"))
    return hit.select("doc", "key", F.col("p.template").alias("template"), F.col("p.n").alias("n"), F.col("p.t").alias("t"), "w")


def spans(docs: DataFrame, table: DataFrame, n_names: int) -> DataFrame:
    """(doc, key, template, start, end, score): the verified places of all templates, in words, end exclusive.

    score is the share of the template's words that the span covers; 1 for names.
    """
    cast = stored(votes(docs, table).groupBy("doc", "key", "template", "n", (F.col("w") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts")))
    names = cast.where((F.col("template") < n_names) & (F.size("ts") == F.col("n") - NAME_GRAM + 1))
    names = names.select("doc", "key", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n")).alias("end"), F.lit(1.0).alias("score"))
    # Of a notice: islands of diagonals, and what they cover together.
    notices = cast.where(F.col("template") >= n_names)
    order = W.partitionBy("doc", "key", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1))
    notices = notices.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first, last = F.col("diagonal") + F.array_min("ts"), F.col("diagonal") + F.array_max("ts") + NOTICE_GRAM
    covered = F.flatten(F.transform("ts", lambda t: F.sequence(t, t + NOTICE_GRAM - 1)))
    place = notices.select("doc", "key", "template", "n", "island", first.alias("first"), last.alias("last"), F.explode(covered).alias("t"))
    place = place.groupBy("doc", "key", "template", "n", "island").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.count_distinct("t").alias("said"))
    place = place.withColumn("score", F.least(F.lit(1.0), F.col("said") / F.col("n")))
    place = place.where((F.col("score") >= COVER) & (F.col("end") - F.col("start") <= F.ceil(STRETCH * F.col("n"))))
    return names.unionByName(place.select(*names.columns))


def scan_licenses(docs: DataFrame, names: list[tuple[str, str]] = NAMES, notices: list[tuple[str, str]] = NOTICES, base: int = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts the places of the first `base` names, first_word and last_word are the first words of the first and the
    last of them (null without any). Labels are distinct, sorted and comma-joined; score is the best cover of any template,
    0 without any. A null or empty text has no words and no labels. Rows with equal doc_id are judged each by its own text,
    equal rows alike; an empty table gives an empty one. Other columns are not read, whatever their names.
    """
    table = templates(docs.sparkSession, names, notices)
    labels = F.array(*[F.lit(x) for x in [label for _, label in names] + [label for label, _ in notices]])
    found = spans(docs, table, len(names)).withColumn("label", F.get(labels, F.col("template")))
    mine = F.col("template") < base
    per = found.groupBy("doc", "key").agg(
        F.count_if(mine).alias("n_base"),
        F.min(F.when(mine, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(mine, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(mine, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = docs.select("doc_id", document_key().alias("_key"), F.coalesce(F.regexp_count("text", F.lit(CASED_WORD)), F.lit(0)).cast("long").alias("n_words"))
    both = rows.join(per, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_key") == F.col("key")), "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
