"""License scans by diagonal voting, in DataFrame functions only.

Every document and every template is cut into rolling word k-grams. A join of their hashes gives,
for each meeting place, the diagonal ``document word - template word``; grams of one copy of a
template vote for one diagonal. Diagonals at most ``slack`` words apart are merged, because an
inserted or missing word moves the rest of a copy to a neighbour. A merged span is verified on the
words themselves: equal grams must cover ``COVER`` of the words of a template of ``LONG`` or more, and
all words of a shorter one, where one word is the version.

A template of two or three words is a single gram, its slack is 0 and it must be covered whole, so
each of its spans is one place of the phrase.

Defined results: a null text is empty; a text without words keeps its row, with no places, no labels
and score 0; repeated rows and repeated or null ids keep rows of their own; of equal covers
every template counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattlens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words
GRAM = 4  # words in a gram; a shorter template, of two words at least, is one gram of its own length
COVER, LONG = 0.8, 20  # share of the words that equal grams must cover of templates this long; shorter ones must match whole
SMALL = 1_000_000  # characters of all templates up to which their grams are broadcast

# fixed values: phrases that count as places, with their labels
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

# fixed values: public license notices, with labels of our own
NOTICES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-notice", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)


def words(text: Column) -> Column:
    """The words of a text, with only A-Z lowered: what stands between runs of other characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), "")


def template_table(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, label, base, words, width, slack) of every template, from literals."""
    rows = [(n, *row) for n, row in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in notices])]
    listed = F.array(
        *[F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base")) for n, label, text, base in rows]
    )
    table = spark.range(1).select(F.inline(listed)).withColumn("words", words(F.col("text"))).drop("text")
    return table.withColumns({"width": F.least(F.size("words"), F.lit(GRAM)), "slack": F.floor(F.size("words") / 10).cast("int")}).filter("width > 1")


def template_grams(templates: DataFrame) -> DataFrame:
    """(gram, template, at, held): hash, place and words of every rolling gram of the templates."""
    at = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width")))
    placed = templates.select("template", "words", "width", at.alias("at"))
    held = F.slice("words", F.col("at") + 1, F.col("width"))
    gram = F.coalesce(*[F.when(F.col("width") == n, _gram([F.get("words", F.col("at") + i) for i in range(n)])) for n in range(2, GRAM + 1)])
    return placed.select(gram.alias("gram"), "template", "at", F.array_join(held, " ").alias("held"))


def _gram(parts: Sequence[Column]) -> Column:
    """Hash of the words of a gram, which differs between widths; null where the text ends before."""
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(len(parts)), *parts))


def _meetings(docs: DataFrame, grams: DataFrame, few: bool) -> DataFrame:
    """One row for every gram of a document that a template has too, and one for every document.

    (row, doc_id, n_words, first, template, at, held, place, found): ``first`` marks the row that
    every document has; ``template`` is null where nothing meets. Texts are split once and only
    words travel on, so that what leaves the scan is small.
    """
    listed = docs.select("doc_id", words(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    later = [F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(GRAM)]
    placed = listed.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*later)).alias("place", "_w")
    )
    parts = [F.col(f"_w.w{i}") for i in range(GRAM)]
    hashed = [_gram(parts[:width]) for width in range(2, GRAM + 1)]
    rolled = placed.select(
        "row", "doc_id", "n_words", "place", *parts, F.posexplode(F.array(F.lit(None).cast("long"), *hashed)).alias("kind", "gram")
    )
    rolled = rolled.filter(F.col("gram").isNotNull() | ((F.col("kind") == 0) & (F.coalesce("place", F.lit(0)) == 0)))
    met = rolled.join(F.broadcast(grams) if few else grams, "gram", "left").filter("template IS NOT NULL OR kind = 0")
    found = F.array_join(F.slice(F.array(*[f"w{i}" for i in range(GRAM)]), 1, F.col("kind") + 1), " ")
    return met.select(
        "row",
        "doc_id",
        "n_words",
        (F.col("kind") == 0).alias("first"),
        "template",
        "at",
        "held",
        F.col("place").cast("long").alias("place"),
        F.when(F.col("template").isNotNull(), found).alias("found"),
    )


def spans(meetings: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified spans: (row, template, label, base, first_word, last_word, cover)."""
    votes = meetings.filter("template IS NOT NULL").withColumn("diagonal", F.col("place") - F.col("at"))
    votes = votes.groupBy("row", "template", "diagonal").agg(
        F.min("place").alias("low"),
        F.max("place").alias("high"),
        F.collect_set(F.when(F.col("held") == F.col("found"), F.col("at"))).alias("ats"),  # at most one per template word
    )
    facts = templates.select("template", "label", "base", "width", "slack", F.size("words").alias("length"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    merged = (
        votes.join(F.broadcast(facts), "template")  # one row per template, a parameter
        .withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("group", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.explode("ats"))
        .groupBy("row", "template", "group", "label", "base", "width", "length")
        .agg(F.min("low").alias("first_word"), F.max(F.col("high") + F.col("width") - 1).alias("last_word"), F.collect_set("at").alias("ats"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, at + F.col("width") - 1)))))
    return (
        merged.withColumn("cover", covered / F.col("length"))
        .filter(F.col("cover") >= F.when(F.col("length") >= LONG, COVER).otherwise(1.0))
        .select("row", "template", "label", "base", "first_word", "last_word", "cover")
    )


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> tuple[DataFrame, DataFrame]:
    """One row per document (row, doc_id, n_words), and the verified spans of all of them."""
    spark = docs.sparkSession
    templates = template_table(spark, phrases, notices)
    few = sum(len(text) for _, text in (*phrases, *notices)) <= SMALL
    meetings = materialize(_meetings(docs, template_grams(templates), few), "meetings")
    return meetings.filter("first").select("row", "doc_id", "n_words"), spans(meetings, templates)


def label_documents(docs: DataFrame) -> DataFrame:
    """Per document: words, places of the base phrases, base and all labels, best cover as score."""
    rows, found = scan(docs)
    place = F.when(F.col("base"), F.col("first_word"))
    per_row = found.groupBy("row").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    zero = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(per_row, "row", "left").drop("row").fillna(zero)
