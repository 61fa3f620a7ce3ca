"""License scan: phrases that stand word for word, and an exact set-similarity join of text blocks with license templates.

A block is BLOCK_WORDS consecutive words; blocks start at every half of that, so a notice of up to half a block lies
whole in one. A block meets a template if it holds THRESHOLD or more of the template's distinct words. The join finds
all such pairs without comparing every block:

- Words of the templates are ordered by their counts over all texts, rare ones first. Other words of a block cannot be
  shared, so a block is the sorted set of its template words.
- Prefix filter: of a template of s words of which c must be shared, one of the s - c + 1 rarest is in any block that
  meets it. Only blocks around such words are made; of these only the rarest n - c + 1 words are looked up.
- Length filter: the block has c template words or more.
- Positional filter: from the place of the shared word on, both sides have c words left or more. At the first shared
  word, all others come after it on both sides, so no pair is lost.
- What remains is counted exactly.

All of it is built-in functions, joins and groupings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import text_hash, written

# Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Notices that the method looks for: label, text.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]

#: Part of a template's distinct words that a block must hold, and the words of a block.
THRESHOLD, BLOCK_WORDS = 0.8, 64
#: Rows of templates (words or index entries) that may be broadcast, some 50 MB, and of found texts.
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (A-Z as a-z) and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN), "")


def phrase_places(array: Column, joined: Column, phrase: str) -> Column:
    """Starts, from 0, of the places where the words of ``phrase`` stand consecutively; ``joined`` is the array with blanks between."""
    parts = phrase.split(" ")
    last = F.size(array) - len(parts)
    stands = lambda i: reduce(lambda a, b: a & b, [F.get(array, i + k) == w for k, w in enumerate(parts)])
    return F.when((last >= 0) & F.contains(joined, F.lit(phrase)), F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written) to be broadcast if it has BROADCAST_ROWS rows or fewer, else to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ordered_templates(texts: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (word, n) with counts over ``texts`` (words), and the templates (label, body, size, need), whose ``body``
    is the sorted set of (n, word), ``need`` the words that must be shared. Both are written."""
    sets = templates.select("label", F.array_sort(F.array_distinct(words(F.col("text")))).alias("_set")).where("size(_set) > 0").distinct()
    sets = written(sets, "license-templates")
    vocabulary = _small(written(sets.select(F.explode("_set").alias("word")).distinct(), "license-words"))
    counts = texts.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = written(vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "license-word-counts")
    body = sets.select("label", "_set", F.explode("_set").alias("word")).join(_small(counts), "word")
    body = body.groupBy("label", "_set").agg(F.array_sort(F.collect_set(F.struct("n", "word"))).alias("body"))
    size = F.size("body")
    found = body.select("label", "body", size.alias("size"), F.ceil(size * threshold - 1e-9).cast("int").alias("need"))
    return counts, written(found, "license-bodies")


def license_blocks(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every block that meets a template: doc_id, text_hash, first_word (from 0), label, shared (words), score (their part of the template's).

    ``templates`` has label and text. A pair of block and template comes once for each of the block's looked-up
    words. Null and empty texts, and templates without words, meet nothing; rows that repeat id and text count once;
    rows without id are kept apart by text. Empty tables give no rows; other columns are ignored.
    """
    step = max(1, block_words // 2)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    counts, bodies = ordered_templates(texts, templates, threshold)
    counts = _small(counts)
    index = bodies.select("label", "body", "size", "need", F.posexplode(F.slice("body", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "token"))
    index = _small(written(index.select("label", "body", "size", "need", "i", F.col("token.word").alias("word")), "license-index"))

    # Blocks around the rare words of the templates.
    hits = texts.select("doc_id", "text_hash", "words", F.posexplode("words").alias("at", "word")).join(_small(index.select("word").distinct()), "word", "left_semi")
    near = F.expr(f"at DIV {step}").cast("int")
    hits = hits.select("doc_id", "text_hash", "words", F.explode(F.when(near > 0, F.array(near, near - 1)).otherwise(F.array(near))).alias("block"))
    hits = hits.select("doc_id", "text_hash", "block", F.slice("words", F.col("block") * step + 1, F.lit(2 * step)).alias("part"))
    key = ["doc_id", "text_hash", "block"]
    blocks = hits.groupBy(*key).agg(F.first("part").alias("part"))
    sets = blocks.select(*key, F.explode(F.array_distinct("part")).alias("word")).join(counts, "word")
    sets = sets.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("n", "word"))).alias("tokens"))

    probe = sets.select(*key, "tokens", F.size("tokens").alias("held"), F.posexplode("tokens").alias("j", "token"))
    met = probe.withColumn("word", F.col("token.word")).drop("token").join(index, "word")
    met = met.where("held >= need AND j <= held - need AND 1 + least(size - i, held - j) - 1 >= need")
    shared = F.size(F.array_intersect(F.col("tokens.word"), F.col("body.word")))
    met = met.select(*key, "label", "size", "need", shared.alias("shared")).where("shared >= need")
    return met.select("doc_id", "text_hash", (F.col("block") * step).alias("first_word"), "label", "shared", (F.col("shared") / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, places (label, start) of the PHRASES by start, templates (labels met, sorted), score.

    The score is 1 where a phrase stands, else the largest part of a template that a block holds, 0 if none meets
    the threshold. Null and empty texts have no words, places or labels and score 0. Repeated rows are each returned;
    a row without id is matched by its text. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(TEMPLATES, "label string, text string") if templates is None else templates
    found = license_blocks(docs, templates, id_col, text_col, threshold, block_words)
    found = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("label")).alias("_met"), F.max("score").alias("_part"))
    found = _small(written(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_met", "_part"), "license-labels"))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    rows = rows.select("doc_id", "text_hash", "words", F.array_join("words", " ").alias("joined"))
    places = [_labelled(phrase_places(F.col("words"), F.col("joined"), phrase), label) for phrase, label in PHRASES]
    rows = rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.array_sort(F.concat(*places)).alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    none = F.array().cast("array<string>")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("_part", F.lit(0.0)))
    return rows.join(found, same, "left").select("doc_id", "n_words", "places", F.coalesce("_met", none).alias("templates"), score.alias("score"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from what ``scan_licenses`` returns."""
    starts, base = F.col("places.start"), F.col("places.label")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("templates"))).alias("labels"), "score",
    )
