"""Benchmark decontamination by spaced seeds.

A text and a benchmark item overlap if, laid on each other without gaps, some WINDOW consecutive words agree
in NEEDED places or more: words may be substituted, not inserted. Each mask picks five words and ignores the
places between them; the hash of the picked words is a seed. Any such window holds, under one of the masks, five
picked words that all agree, so an equal seed leads to every overlap. Around each hit the two texts are compared
word by word. All of it is built-in functions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import BROADCAST_IDS, text_hash, without_rows, written

#: Places that a mask compares, from its start. With two substitutions, 13 places always hold one of the two.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 2, 3, 5)]
WINDOW, NEEDED = 13, 11
#: Items shorter than a seed cannot be searched.
LEAST_WORDS = 5
#: Benchmark seeds that are sent to the texts at a time (some 60 MB); more go in lots, each with a pass over the texts.
BROADCAST_SEEDS = 1_000_000
#: Words of an item in which hits at one alignment are one row; it has the words of the text that lie on these and WINDOW - 1 more on both sides.
BLOCK_WORDS = 64
#: Blocks of items that may be broadcast (up to 0.8 KB each); more are joined by shuffle.
BROADCAST_BLOCKS = 50_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, array: str) -> DataFrame:
    """A row for each place and mask of the word hashes in ``array``: ``at`` and ``seed``; places where the mask does not fit have none."""
    n = len(MASKS)
    rows = df.where(F.size(array) >= LEAST_WORDS).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.size(array) - LEAST_WORDS + 1) * n - 1)))
    at, mask = F.expr(f"_k DIV {n}").cast("int"), F.col("_k") % n
    pick = lambda i: F.xxhash64(F.lit(i), *(F.get(F.col(array), at + place) for place in MASKS[i]))
    fits = lambda i: at + max(MASKS[i]) < F.size(array)
    seed = reduce(lambda c, i: c.when((mask == i) & fits(i), pick(i)), range(1, n), F.when((mask == 0) & fits(0), pick(0)))
    return rows.select("*", at.alias("at"), seed.alias("seed")).drop("_k").where("seed IS NOT NULL")


def _hits(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text_hash, b, block, shift, low, piece): the words of a text that lie on a block of an item, where ``seeds`` (seed, b, b_at, words) has a hit in the block.

    ``shift`` is the place of the item's first word in the text, ``low`` that of the piece's first word in the item. No row has the whole text.
    """
    laid = _seeds(texts, "_d").join(F.broadcast(seeds), "seed").withColumn("shift", F.col("at") - F.col("b_at"))
    block = F.expr(f"b_at DIV {BLOCK_WORDS}").cast("int")
    low = F.greatest(block * BLOCK_WORDS - (WINDOW - 1), F.lit(0), -F.col("shift"))
    high = F.least((block + 1) * BLOCK_WORDS + WINDOW - 1, F.col("words"), F.size("_d") - F.col("shift"))
    laid = laid.where(high - low >= F.least(F.lit(WINDOW), F.col("words")))
    return laid.select("doc_id", "text_hash", "b", block.alias("block"), "shift", low.alias("low"), F.slice("_d", F.col("shift") + low + 1, high - low).alias("piece")).distinct()


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, b, first_word, end_word, best) for each document and text of ``items`` (b, _b) that overlap; see overlaps."""
    bodies = items.dropDuplicates(["b"]).select("b", "_b", F.size("_b").alias("words"))
    seeds = written(_seeds(bodies, "_b").select("seed", "b", F.col("at").alias("b_at"), "words"), "benchmark-seeds")
    blocks = bodies.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(words - {LEAST_WORDS}) DIV {BLOCK_WORDS}").cast("int"))))
    start = F.greatest(F.col("block") * BLOCK_WORDS - (WINDOW - 1), F.lit(0))
    blocks = written(blocks.select("b", "block", "words", start.alias("start"), F.slice("_b", start + 1, (F.col("block") + 1) * BLOCK_WORDS + WINDOW - 1 - start).alias("part")), "benchmark-blocks")

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("text_hash"), hashed_words(F.col(text_col)).alias("_d"))
    lots = max(1, -(-seeds.count() // BROADCAST_SEEDS))
    if lots == 1:
        hits = _hits(texts, seeds)
    else:
        # Written one after the other, so that the seeds of one lot are in memory at a time.
        parts = [written(_hits(texts, seeds.where(F.pmod(F.xxhash64("seed"), F.lit(lots)) == i)), "hits") for i in range(lots)]
        hits = reduce(DataFrame.unionByName, parts).distinct()
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks.hint("merge")
    laid = hits.join(blocks, ["b", "block"]).withColumn("_w", F.least(F.lit(WINDOW), F.col("words")))
    equal = F.transform(F.sequence(F.lit(0), F.size("piece") - 1), lambda j: (F.get("piece", j) == F.get("part", j + F.col("low") - F.col("start"))).cast("int"))
    laid = laid.select("doc_id", "text_hash", "b", (F.col("shift") + F.col("low")).alias("_from"), "_w", equal.alias("_equal"))
    sums = F.transform(F.sequence(F.lit(0), F.size("_equal") - F.col("_w")), lambda s: F.aggregate(F.slice("_equal", s + 1, F.col("_w")), F.lit(0), lambda a, b: a + b))
    laid = laid.select("doc_id", "text_hash", "b", "_from", "_w", sums.alias("_sums"))
    need = F.when(F.col("_w") < WINDOW, F.col("_w")).otherwise(NEEDED)
    good = F.filter(F.sequence(F.lit(0), F.size("_sums") - 1), lambda s: F.get("_sums", s) >= need)
    laid = laid.select("doc_id", "text_hash", "b", "_w", "_from", F.array_max("_sums").alias("_best"), good.alias("_good"))
    # The hits without a window go after the aggregate: a filter before it would be pushed down, and the sums made anew for each place.
    found = laid.groupBy("doc_id", "text_hash", "b").agg(
        F.min(F.col("_from") + F.array_min("_good")).alias("first_word"),
        F.max(F.col("_from") + F.array_max("_good") + F.col("_w")).alias("end_word"),
        F.max(F.when(F.size("_good") > 0, F.col("_best"))).alias("best"),
    )
    return found.where("best IS NOT NULL")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(item_id, b, _b): the items that can be searched, their words hashed, and a hash of these."""
    items = benchmark.select(F.col(item_col).alias("item_id"), hashed_words(F.col(item_text_col)).alias("_b")).where(F.size("_b") >= LEAST_WORDS)
    return written(items.distinct().withColumn("b", F.xxhash64("_b")), "benchmark-items")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, text_hash, item_id, first_word and end_word (of the matching windows in the document's words), best (most agreeing words of a window).

    Items of LEAST_WORDS to WINDOW - 1 words must occur whole; shorter, empty and null ones are in no document.
    Null and empty texts overlap nothing. Rows that repeat both an id and a text give one row; rows without
    id are kept apart by their text. Empty tables give no rows; other columns are ignored. Items of equal words are searched once.
    """
    items = _items(benchmark, item_col, item_text_col)
    named = items.select("item_id", "b")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named.hint("merge")
    found = _matches(docs, items, id_col, text_col).join(named, "b")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("best").alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; all columns stay."""
    found = _matches(docs, _items(benchmark, "item_id", "text"), id_col, text_col)
    return without_rows(docs, found.select(F.col("doc_id").alias("id"), "text_hash"), id_col, text_col)
