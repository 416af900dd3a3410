"""License scans by diagonal voting (operator 13); DataFrame functions only.

Every text is cut into words and all its rolling ``GRAM``-word windows are hashed and joined by Spark to the
positions of the same windows in the templates.  A window at word i of a text and j of a template votes for
the diagonal i - j.  Votes are summed by (text, template, diagonal), diagonals at most ``SLACK`` apart are
merged, since words put in or left out shift a diagonal, and the merged spans are verified on the words
themselves: a phrase needs all its words in a row on one diagonal, a notice the share ``SHARE`` of its words.

Texts are told apart by 128 bits of hash, so equal texts are scanned as one.  The results go back to the
documents by a join that is salted, because a third of all documents may be copies of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railweave.llm.frames import stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
SLACK = 4
SHARE = 0.6
SALTS = 16
#: Template windows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 100_000

# Phrases and their labels; they count where their words stand in a row.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Openings of public license texts and usual notices, found also with words changed.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", "isc"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "gpl"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("under the terms of the GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
]


def templates(spark: SparkSession, phrases: list[tuple[str, str]] | None = None,
              notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, text, label, exact): the given phrases (exact) and notices, numbered."""
    rows = [(t, label, True) for t, label in (PHRASES if phrases is None else phrases)]
    rows += [(t, label, False) for t, label in (NOTICES if notices is None else notices)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "template int, text string, label string, exact boolean")


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def windows(here: Column) -> Column:
    """Rolling windows of three words, joined by spaces."""
    n = F.size(here) - (GRAM - 1)
    tail = lambda k: F.slice(here, k, F.greatest(n, F.lit(0)))
    return F.zip_with(F.zip_with(tail(1), tail(2), lambda a, b: F.concat_ws(" ", a, b)), tail(3),
                      lambda ab, c: F.concat_ws(" ", ab, c))


def template_windows(given: DataFrame) -> DataFrame:
    """(hash, gram, template, j, size, label, exact) of every window of every template."""
    cut = given.select("template", "label", "exact", words(F.col("text")).alias("words"))
    return cut.select("template", "label", "exact", F.size("words").alias("size"),
                      F.posexplode(windows(F.col("words"))).alias("j", "gram")).withColumn(
        "hash", F.xxhash64("gram"))


def text_key() -> tuple[Column, Column]:
    """128 bits that tell texts apart; a null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")


def votes(docs: DataFrame, given: DataFrame) -> DataFrame:
    """(one, two, template, size, label, exact, diagonal, places): template positions met per diagonal.

    A hash that meets another window is no vote: the words are compared as well.
    """
    grams = stored(template_windows(given), "template-windows")
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    cut = docs.select(*text_key(), words(F.col("text")).alias("words"))
    mine = cut.select("one", "two", F.posexplode(windows(F.col("words"))).alias("i", "mine")).withColumn(
        "hash", F.xxhash64("mine"))
    met = mine.join(grams, "hash").filter(F.col("mine") == F.col("gram"))
    # Copies of a text vote alike; sets merge before the shuffle, and none outgrows its template.
    return met.groupBy("one", "two", "template", "size", "label", "exact", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.sort_array(F.collect_set("j")).alias("places"))


def _covered(places: Column) -> Column:
    """Template words inside the windows at ``places``."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda j: F.array(*[j + k for k in range(GRAM)])))))


def spans(voted: DataFrame) -> DataFrame:
    """(one, two, template, label, exact, first, last, share): verified places of phrases, merged ones of notices.

    ``share`` is the part of the template's words that the span holds.
    """
    lines = voted.filter(F.col("exact")).filter(F.size("places") == F.col("size") - (GRAM - 1)).select(
        "one", "two", "template", "label", "exact", F.col("diagonal").alias("first"),
        (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    near = Window.partitionBy("one", "two", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True))
    loose = voted.filter(~F.col("exact")).withColumn("begins", begins.cast("int")).withColumn(
        "span", F.sum("begins").over(near))
    merged = loose.groupBy("one", "two", "template", "label", "exact", "size", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.element_at("places", 1)).alias("first"),
        F.max(F.col("diagonal") + F.element_at("places", -1) + GRAM - 1).alias("last"))
    return lines.unionByName(merged.select(
        "one", "two", "template", "label", "exact", "first", "last", (_covered(F.col("places")) / F.col("size")).alias("share")))


def scan_licenses(docs: DataFrame, given: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start (null:
    none).  ``labels`` holds those of the phrases and of notices of which a span holds at least ``share``;
    both lists are distinct, sorted and joined by commas (empty: none).  ``score`` is 1 with a phrase, else the
    largest share of a notice.  ``spans`` lists (label, first, last, share) of what gave a label, by place.
    Null and empty texts have no words; repeated rows count each; other columns are ignored; no rows give no rows.
    """
    given = templates(docs.sparkSession) if given is None else given
    if given.filter(F.col("exact") & (F.size(words(F.col("text"))) < GRAM)).count():
        raise ValueError(f"a phrase needs at least {GRAM} words")
    found = stored(spans(stored(votes(docs, given), "votes")), "spans")
    holds = F.col("exact") | (F.col("share") >= share)
    start = F.when(F.col("exact"), F.col("first"))
    results = found.groupBy("one", "two").agg(
        F.count(start).alias("n_base"), F.min(start).cast("bigint").alias("first_word"),
        F.max(start).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(holds, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.when(holds, F.struct(
            F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "label", "share")
        ))).alias("spans"))
    salted = stored(results, "licenses").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(),
        F.regexp_count(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                   "abcdefghijklmnopqrstuvwxyz"), F.lit(WORDS)).cast("bigint").alias("n_words"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    none = F.lit(0)
    return rows.join(salted, ["one", "two", "salt"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", none).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
