"""Language identification by character language models with interpolated Kneser-Ney smoothing.

One model a language. Texts become lower-case letters with single blanks for all else. Spark counts the
n-grams of the highest order over every training text; the lower orders count in how many different n-grams of
the next order a suffix occurs (its continuation count), as Kneser-Ney wants. The models are arrays sorted by a
64-bit hash of the n-gram. A text gets the language of the lowest cross-entropy per character, and is marked as
rejected if that is further above the language's training texts than their spread explains.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import append_columns, in_steps, text_hash, written

#: Characters of the longest n-gram. Four 16-bit symbols are one 64-bit number.
ORDER = 4
#: Rows that all models together may have to be broadcast (24 bytes each); with more, they stay a table that is joined.
MAX_ROWS = 6_000_000
#: Rejection: so many standard deviations above the mean cross-entropy of the language's training texts.
REJECT_SPREADS = 4.0
#: Characters that make a text certain: the score of a shorter one is drawn towards an even guess.
SURE_CHARS = 40
#: Counted n-grams a task holds before it passes them on.
_HELD = 2_000_000
_BLANK, _START = 32, 0
_BITS, _SYMBOL = 16, 0xFFFF


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """16-bit symbol of each code point: itself for a letter or mark (folded beyond the basic plane), else the blank."""
    table = np.full(0x110000, _BLANK, np.uint16)
    letters = np.array([i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"], np.int64)
    table[letters] = np.where(letters < 0xD800, letters, 0xD800 + letters % (0xFFFF - 0xD800))
    return table


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, one for each character, the text each belongs to, and which texts have a letter.

    Every text starts after ``order`` - 1 start symbols, with a blank; runs of other characters are one blank.
    """
    pad = "\0" * (order - 1) + " "
    lowered = [x.lower() for x in texts]
    lengths = np.array([len(x) for x in lowered], np.int64) + len(pad)
    codes = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    owner = np.repeat(np.arange(len(texts)), lengths)
    symbol = symbols()[codes]
    first = (starts[:, None] + np.arange(order - 1)).ravel()
    symbol[first] = _START
    lettered = np.zeros(len(texts), bool)
    lettered[owner[symbol > _BLANK]] = True
    kept = (symbol != _BLANK) | np.r_[True, symbol[:-1] != _BLANK]
    symbol, owner = symbol[kept].astype(np.int64), owner[kept]
    gram = np.zeros(len(symbol), np.int64)
    for back in range(order):
        gram[back:] |= symbol[: len(symbol) - back] << (_BITS * back)
    real = symbol != _START
    return gram[real], owner[real], lettered


def count_ngrams(training: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all texts of ``training`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pd.Series] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(counts.index.to_numpy(np.int64)), pa.array(counts.to_numpy(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for step, texts in in_steps(batches):
            langs = np.array(step.column(0).to_pylist(), object)
            gram, owner, _ = ngrams(texts, order)
            for lang in sorted(set(langs)):
                code, names = pd.factorize(gram[(langs == lang)[owner]])
                counts = pd.Series(np.bincount(code, minlength=len(names)), index=names)
                held[lang] = held[lang].add(counts, fill_value=0) if lang in held else counts
            if sum(map(len, held.values())) > _HELD:
                yield from out()
        yield from out()

    return training.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame, order: int) -> DataFrame:
    """The model rows (lang, order, gram, term, rest) of highest-order ``counts``.

    ``term`` is the discounted share of an n-gram after its context; ``rest`` is, for a context, the share
    left to the next lower order. A row with a null ``rest`` is an n-gram, one with a null ``term`` a context.
    """
    parts = []
    level = counts
    for n in range(order, 0, -1):
        tally = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        # The usual estimate, kept inside (0, 1) where singletons or pairs are missing.
        discount = tally.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2")))).alias("d"))
        context = F.expr(f"shiftrightunsigned(gram, {_BITS})")
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discount), "lang")
        terms = level.withColumn("context", context).join(totals, ["lang", "context"])
        parts.append(terms.select("lang", F.lit(n).alias("order"), "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("term"), F.lit(None).cast("double").alias("rest")))
        parts.append(totals.select("lang", F.lit(n).alias("order"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("term"), (F.col("d") * F.col("kinds") / F.col("total")).alias("rest")))
        if n > 1:
            suffix = F.col("gram").bitwiseAND((1 << (_BITS * (n - 1))) - 1)
            level = level.groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Models:
    """Sorted hash arrays of all languages and orders."""

    def __init__(self, rows: pd.DataFrame, order: int):
        self.order = order
        self.langs = sorted(rows["lang"].unique())
        self.floor = 1.0 / (1 + rows.loc[(rows["order"] == 1) & rows["term"].notna(), "gram"].nunique())
        self.tables: dict[tuple[int, int, str], tuple[np.ndarray, np.ndarray]] = {}
        for (lang, n), part in rows.groupby(["lang", "order"]):
            for kind in ("term", "rest"):
                own = part[part[kind].notna()]
                keys = mixed(own["gram"].to_numpy(np.int64))
                place = np.argsort(keys)
                self.tables[self.langs.index(lang), int(n), kind] = keys[place], own[kind].to_numpy(np.float64)[place]

    def _find(self, lang: int, n: int, kind: str, grams: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.tables[lang, n, kind]
        wanted = mixed(grams)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last symbol of each n-gram after the others: a row for each language."""
        out = np.empty((len(self.langs), len(grams)))
        for lang in range(len(self.langs)):
            p = np.full(len(grams), self.floor)
            for n in range(1, self.order + 1):
                part = grams & ((1 << (_BITS * n)) - 1) if n < 4 else grams
                context = (part.astype(np.uint64) >> np.uint64(_BITS)).astype(np.int64)
                p = self._find(lang, n, "term", part, 0.0) + self._find(lang, n, "rest", context, 1.0) * p
            out[lang] = -np.log2(p)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the characters counted (0: no letter)."""
        gram, owner, lettered = ngrams(texts, self.order)
        code, names = pd.factorize(gram)
        bits = self.bits(np.asarray(names, np.int64))
        length = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, b[code], minlength=len(texts)) for b in bits], axis=1) if len(bits) else np.zeros((len(texts), 0))
        return sums / np.maximum(length, 1)[:, None], np.where(lettered, length, 0)


class ModelTable:
    """Models too large to be broadcast: their rows stay a table, only the languages and the floor are known here."""

    def __init__(self, rows: DataFrame, order: int):
        self.rows, self.order = rows, order
        self.langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
        self.floor = 1.0 / (1 + rows.where("order = 1 AND term IS NOT NULL").select("gram").distinct().count())

    def _level(self, n: int, kind: str, missing: float) -> DataFrame:
        """(gram, values): the ``kind`` of each n-gram or context in every language."""
        own = self.rows.where((F.col("order") == n) & F.col(kind).isNotNull())
        each = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col(kind))), F.lit(missing)) for x in self.langs]
        return own.groupBy("gram").agg(F.array(*each).alias("values"))

    def bits(self, grams: DataFrame) -> DataFrame:
        """(gram, bits) of the distinct ``grams`` (gram), as Models.bits has them: a value for each language."""
        out = grams.withColumn("p", F.array(*[F.lit(self.floor) for _ in self.langs]))
        every = lambda missing: F.array(*[F.lit(missing) for _ in self.langs])
        for n in range(1, self.order + 1):
            part = F.col("gram").bitwiseAND((1 << (_BITS * n)) - 1) if n < 4 else F.col("gram")
            out = out.withColumn("part", part).withColumn("context", F.shiftrightunsigned("part", _BITS))
            terms = self._level(n, "term", 0.0).select(F.col("gram").alias("part"), F.col("values").alias("terms"))
            rests = self._level(n, "rest", 1.0).select(F.col("gram").alias("context"), F.col("values").alias("rests"))
            out = out.join(terms, "part", "left").join(rests, "context", "left")
            rest = F.zip_with(F.coalesce("rests", every(1.0)), "p", lambda r, q: r * q)
            out = out.select("gram", F.zip_with(F.coalesce("terms", every(0.0)), rest, lambda t, r: t + r).alias("p"))
        return out.select("gram", F.transform("p", lambda q: -F.log2(q)).alias("bits"))

    def sums(self, texts: DataFrame) -> DataFrame:
        """(hash, sums, chars) of the lettered ``texts`` (hash, text): bits of the whole text in each language, and its characters."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step, part in in_steps(batches):
                gram, owner, lettered = ngrams(part, order)
                gram, owner = gram[lettered[owner]], owner[lettered[owner]]
                place = np.lexsort((gram, owner))
                gram, owner = gram[place], owner[place]
                first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]) if len(gram) else np.zeros(0, np.int64)
                hashes = step.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[owner[first]]), pa.array(gram[first]), pa.array(np.diff(np.r_[first, len(gram)]).astype(np.int64))], names=["hash", "gram", "n"])

        order = self.order
        counts = written(texts.select("hash", "text").mapInArrow(run, "hash bigint, gram bigint, n bigint"), "text-ngrams")
        bits = self.bits(counts.select("gram").distinct())
        each = [F.sum(F.col("n") * F.col("bits")[i]) for i in range(len(self.langs))]
        return counts.join(bits, "gram").groupBy("hash").agg(F.array(*each).alias("sums"), F.sum("n").alias("chars"))


def fit(training: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS) -> Models | ModelTable | None:
    """Models of ``training`` (lang, text), over all its rows; rows with a null lang or text say nothing. None without training texts.

    Their rows are counted first: up to ``max_rows`` they go to every task, more stay a table in the shared
    folder. The order is the same for any number.
    """
    counts = written(count_ngrams(training.where("lang IS NOT NULL AND text IS NOT NULL"), order), "ngrams")
    model = written(smoothed(counts, order), "language-models")
    rows = model.count()
    if rows > max_rows:
        return ModelTable(model, order)
    return Models(model.toPandas(), order) if rows else None


_FOUND = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("chars", T.LongType())]


def identify(docs: DataFrame, models: Models | ModelTable | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, bits (cross-entropy per character of that language), chars.

    A text that is null, empty or without a letter is "und" with score 0 and null bits, and so is every text
    without models. Equal languages go to the first by name. The score is the probability of the language if a
    text of SURE_CHARS characters had this cross-entropy, less for shorter ones: from 1 / languages to 1. Columns
    with the names of new ones are replaced, all others stay; an empty table gives no rows.
    """
    if isinstance(models, ModelTable):
        return _identify_by_join(docs, models, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(texts: list[str]) -> list[pa.Array]:
        models = shared.value
        if models is None:
            return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.nulls(len(texts), pa.float64()), pa.array([0] * len(texts), pa.int64())]
        bits, chars = models.entropies(texts)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(chars, SURE_CHARS)[:, None]
        score = 1 / np.exp2(-gap).sum(axis=1)
        none = chars == 0
        names = np.where(none, "und", np.array(models.langs, object)[best])
        least = bits[np.arange(len(texts)), best]
        return [pa.array(names.tolist(), pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(least, mask=none), pa.array(chars.astype(np.int64))]

    return append_columns(docs, text_col, _FOUND, run)


def _identify_by_join(docs: DataFrame, models: ModelTable, text_col: str) -> DataFrame:
    """``identify`` with the n-grams of all distinct texts joined to the model rows."""
    new = {f.name for f in _FOUND}
    hashed = docs.select(text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    sums = models.sums(hashed.dropDuplicates(["hash"])).select(F.col("hash").alias("_hash"), F.transform("sums", lambda x: x / F.col("chars")).alias("_each"), F.col("chars").alias("_chars"))
    least = F.array_min("_each")
    found = sums.withColumn("_bits", least).withColumn("_lang", F.array(*map(F.lit, models.langs))[(F.array_position("_each", least) - 1).cast("int")])
    chances = F.transform("_each", lambda x: F.pow(F.lit(2.0), -(x - F.col("_bits")) * F.least("_chars", F.lit(SURE_CHARS))))
    found = found.withColumn("_score", 1 / F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)).drop("_each")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    # The columns of ``docs`` travel as one, so that none can clash with a helper column.
    out = docs.select(F.struct(*kept).alias("row"), text_hash(text_col).alias("key")).join(found, F.col("key") == F.col("_hash"), "left")
    return out.select("row.*", F.coalesce("_lang", F.lit("und")).alias("lang_pred"), F.coalesce("_score", F.lit(0.0)).alias("score"), F.col("_bits").alias("bits"), F.coalesce("_chars", F.lit(0)).cast("bigint").alias("chars"))


def calibrated(found: DataFrame, training: DataFrame, spreads: float = REJECT_SPREADS) -> DataFrame:
    """``found`` with ``rejected``: the cross-entropy lies ``spreads`` standard deviations above the mean of the language's ``training`` rows (lang_pred, bits, with lang_pred right), or there is no language. Short texts get the margin widened by the root of their shortness."""
    limits = training.where("bits IS NOT NULL").groupBy("lang_pred").agg(F.avg("bits").alias("_mean"), F.coalesce(F.stddev_pop("bits"), F.lit(0.0)).alias("_spread"))
    limits = limits.withColumnRenamed("lang_pred", "_lang")
    room = F.sqrt(F.greatest(F.lit(1.0), SURE_CHARS * 10 / F.col("chars")))
    above = F.col("bits") > F.col("_mean") + spreads * F.greatest("_spread", F.lit(0.05)) * room
    # A row a language, so the limits are small whatever the corpus.
    kept = [F.col(f"`{c}`") for c in found.columns if c != "rejected"]
    rows = found.select(F.struct(*kept).alias("row"), "lang_pred", "bits", "chars")
    return rows.join(F.broadcast(limits), F.col("lang_pred") == F.col("_lang"), "left").select("row.*", F.coalesce(above, F.lit(True)).alias("rejected"))
