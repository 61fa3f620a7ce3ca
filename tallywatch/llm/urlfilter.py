"""URL filter: prefix rules, decided for every key of the corpus by a cascade of Bloom filters.

The key of a URL is its host and the start of its path, as long as the longest rule path; all URLs of one key
get the same decision. The distinct keys of the corpus are the universe. Level 1 of the cascade encodes the listed
(blocked) keys, level 2 the other keys that level 1 lets through by mistake, level 3 the listed keys that level
2 lets through, and so on until a level lets none through. Over that universe the cascade answers exactly, so a
URL is judged by bit tests on constants, without a join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import unused, written

#: (verdict, host, path prefix).
Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: False positive rates of the first and of the later levels. The first is lower where unlisted keys are many: its false
#: positives, which level 2 encodes, shall be half as many as the listed keys; not below LEAST_RATE.
FIRST_RATE, LATER_RATE, LEAST_RATE = 0.02, 0.25, 2.0**-40
#: Bits of a level that still travel with the plan (2 MB). Every level is checked before it is built; where one would be larger, keys are joined instead.
MAX_BITS = 1 << 24
_MAX_LEVELS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, null if none does; the first listed wins a tie."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)) for _, h, p in longest]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def key_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Host and the first characters of the path, as many as the longest rule path has: they decide which rules fit."""
    length = max([len(p) for _, _, p in rules], default=0)
    return F.concat(host, F.lit(" "), F.substring(path, 1, length))


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def shape(n: int, rate: float) -> tuple[int, int]:
    """Hashes and bits of a Bloom filter for ``n`` keys."""
    hashes = max(1, round(math.log2(1 / rate)))
    return hashes, max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)


class Level:
    """One Bloom filter: 64-bit words, kept as a constant of the plan."""

    def __init__(self, keys: DataFrame, n: int, number: int, rate: float):
        self.number = number
        self.hashes, self.bits = shape(n, rate)
        places = keys.select(F.explode(F.array(*_places(F.col("key"), number, self.hashes, self.bits))).alias("place"))
        words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
        self.words = [0] * (self.bits // 64)
        for word, bits in words.collect():  # at most MAX_BITS / 64 rows
            self.words[word] = bits

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _places(key, self.number, self.hashes, self.bits)]
        return reduce(lambda a, b: a & b, hit)


def cascade(universe: DataFrame, max_bits: int | None = None) -> list[Level] | None:
    """Levels for ``universe`` (key string, listed boolean; distinct keys), empty if nothing is listed; None if a level would have over ``max_bits`` bits."""
    sets = {True: universe.where("listed"), False: universe.where("NOT listed")}
    side, n, levels = True, sets[True].count(), []
    others = sets[False].count() if n else 0
    rate = max(LEAST_RATE, min(FIRST_RATE, n / (2 * others))) if others else FIRST_RATE
    while n:
        if len(levels) == _MAX_LEVELS:
            raise RuntimeError("the cascade does not end; are the keys distinct?")
        if max_bits is not None and shape(n, rate)[1] > max_bits:
            return None
        level = Level(sets[side], n, len(levels) + 1, rate)
        levels.append(level)
        side, rate = not side, LATER_RATE
        sets[side] = sets[side].where(level.has(F.col("key")))
        n = sets[side].count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the number of levels it passes in a row is odd."""
    inside: Column = F.lit(False)
    for level in reversed(levels):
        inside = level.has(key) & ~inside
    return inside


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict ("allow" or "block").

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins. A URL
    that no rule fits is in no listed key, so the cascade allows it. Null URLs and URLs without ``://`` have
    empty host and path. Repeated rows are all judged; an empty table gives no rows; columns that have the
    names of new ones are replaced, others stay.
    """
    rules = RULES if rules is None else rules
    verdicts = {h + p: verdict for verdict, h, p in reversed(rules)}
    blocked = [text for text, verdict in verdicts.items() if verdict == "block"]
    host, path = host_and_path(F.col(url_col))
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    key = key_of(F.col("host"), F.col("path"), rules)
    judged = rows.select(key.alias("key"), F.coalesce(F.col("rule").isin(blocked), F.lit(False)).alias("listed"))
    universe = written(judged.groupBy("key").agg(F.bool_or("listed").alias("listed")), "url-keys")
    levels = cascade(universe, max_bits)
    if levels is None:
        mark = unused("_listed", rows)
        marks = universe.where("listed").select(F.col("key").alias(mark))
        rows, inside = rows.join(marks, key == F.col(mark), "left"), F.col(mark).isNotNull()
        return rows.withColumn("verdict", F.when(inside, "block").otherwise("allow")).drop(mark)
    return rows.withColumn("verdict", F.when(member(levels, key), "block").otherwise("allow"))
