"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by figures of its characters and words and encoded
by a small layer. Two gates give each passage a weight (tanh times sigmoid, then a softmax within the document);
the weighted sum of the encoded passages is the document, and a logistic unit scores it. Only documents carry
labels: the weights of the passages are learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import append_columns, in_steps

PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on: those with the smallest hashes of their ids. Only the fit is bounded so.
FIT_DOCS = 3_000
#: Documents with more passages than this are left out of the fit (never out of the scoring).
FIT_PASSAGES = 500
HIDDEN, GATES, ROUNDS, RATE, DECAY = 16, 8, 120, 0.05, 1e-4
LEAST_SCORE = 0.3

_FEATURES = 19


def _classes() -> np.ndarray:
    """Class of each character below 256; higher ones count as lower-case letters."""
    table = np.full(256, 5, np.uint8)
    for i in range(256):
        c = chr(i)
        table[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\r\x0b\x0c" else 4 if c in ".,;:'\"-()?" else 5
    table[ord("\n")], table[ord("|")], table[ord("!")] = 6, 7, 8
    return table


_CLASS = _classes()


def describe(text: str) -> np.ndarray:
    """A row of figures for each passage of PASSAGE_WORDS words; a text without words is one row of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, _FEATURES), np.float32)
    total = len(words)
    starts = np.arange(0, total, PASSAGE_WORDS)
    n = np.diff(np.r_[starts, total])
    flags = lambda found, size=total: np.fromiter(found, np.float64, size)
    mean = lambda values: np.add.reduceat(values, starts) / n
    sizes = flags(map(len, words))
    # Characters of the words with a blank after each; classes are counted per passage.
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 256, _CLASS[np.minimum(codes, 255)], 0)
    ends = np.cumsum(sizes + 1).astype(np.int64)
    passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[0, ends[np.r_[starts[1:], total] - 1]]))
    counts = np.bincount(passage * 9 + kinds, minlength=9 * len(starts)).reshape(-1, 9)
    last = kinds[ends - 2]
    length = mean(sizes)
    again = np.r_[0.0, flags(map(eq, words, words[1:]), total - 1)]
    rows = [
        *(counts[:, [0, 1, 2, 3, 4, 5, 7, 8]] / counts.sum(axis=1, keepdims=True)).T,
        length,
        np.sqrt(np.maximum(mean(sizes * sizes) - length * length, 0)),
        np.array([len(set(words[s : s + PASSAGE_WORDS])) for s in starts.tolist()]) / n,
        mean(again),
        mean(flags(map(str.isupper, words))),
        mean(flags(map(str.istitle, words))),
        mean(flags(map(str.isalpha, words))),
        mean((last == 4).astype(np.float64)),
        mean((last <= 2).astype(np.float64)),
        np.maximum.reduceat(sizes, starts),
        np.full(len(starts), min(1.0, text.count("\n") / total)),
    ]
    return np.stack(rows, axis=1).astype(np.float32)


class Attention:
    """The model; bags are given as stacked passages and the start of each bag."""

    def __init__(self, width: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        shape = {"w": (width, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: draw.standard_normal(s) / np.sqrt(s[0]) if len(s) == 2 or k in "ac" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.spread = np.zeros(width), np.ones(width)

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, counts = self.p, np.diff(np.r_[starts, len(rows)])
        x = np.clip((rows - self.mean) / self.spread, -8, 8).astype(np.float64)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))), "counts": counts}

    def fit(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the mean log loss, all bags at once."""
        self.mean, self.spread = rows.mean(axis=0, dtype=np.float64), np.maximum(rows.std(axis=0, dtype=np.float64), 1e-6)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, ROUNDS + 1):
            f, p = self.forward(rows, starts), self.p
            wide = lambda a: np.repeat(a, f["counts"], axis=0)
            error = (f["score"] - labels) / len(labels)
            dz = error[:, None] * p["c"]
            pull = (wide(dz) * f["h"]).sum(axis=1)
            de = f["weight"] * (pull - wide(np.add.reduceat(f["weight"] * pull, starts)))
            dgate = de[:, None] * p["a"]
            dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
            dh = f["weight"][:, None] * wide(dz) + dt @ p["v"].T + dg @ p["u"].T
            dx = dh * (1 - f["h"] ** 2)
            grad = {"w": f["x"].T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": np.array([error.sum()])}
            for k, v in p.items():
                step = grad[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * step
                second[k] = 0.999 * second[k] + 0.001 * step**2
                p[k] = v - RATE * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, seed: int = 7) -> Attention:
    """A model of ``docs`` and ``labels`` (the id, 0 or 1). The caller leaves out what may not be learned from.

    A null label says nothing; of labels that repeat an id, the mean counts, from a half upwards as 1. Without any
    labelled document the model scores every text 0.5 or so; that is its state before training.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    present = docs.select(F.col(id_col).cast("bigint").alias("_id")).distinct()
    chosen = marks.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, texts in in_steps(batches):
            for i, text in enumerate(texts):
                if len(found := describe(text)) <= FIT_PASSAGES:
                    yield pa.RecordBatch.from_pydict({"_id": step.column(0).slice(i, 1), "_label": step.column(2).slice(i, 1), "bag": pa.array([found.ravel().tolist()], pa.list_(pa.float32()))})

    taught = rows.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label")
    # At most fit_docs bags of FIT_PASSAGES passages.
    seen = taught.mapInArrow(bags, "_id bigint, _label double, bag array<float>").dropDuplicates(["_id"]).collect()
    model = Attention(_FEATURES, seed)
    if seen:
        seen.sort(key=lambda r: r["_id"])
        parts = [np.array(r["bag"], np.float32).reshape(-1, _FEATURES) for r in seen]
        model.fit(np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])[:-1]], np.array([r["_label"] for r in seen]))
    return model


def add_scores(docs: DataFrame, model: Attention, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better), predicted (1 from LEAST_SCORE upwards), passages, and top_passage (the one of the largest weight).

    Null, empty and blank texts are one passage without words and get a score too. All rows are scored, repeated
    ones alike; columns with the names of new ones are replaced, others stay; an empty table gives no rows.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.IntegerType()), T.StructField("top_passage", T.IntegerType())]

    def run(texts: list[str]) -> list[pa.Array]:
        parts = [describe(x) for x in texts]
        counts = np.array([len(x) for x in parts])
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        f = model.forward(np.concatenate(parts).astype(np.float64), starts)
        score = np.round(f["score"], 9)
        top = [int(f["weight"][s : s + n].argmax()) for s, n in zip(starts, counts)]
        return [pa.array(score), pa.array((score >= LEAST_SCORE).astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(top, pa.int32())]

    return append_columns(docs, text_col, fields, run)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those the classifier rejects, trained on the labelled ones among them; the columns stay."""
    scored = add_scores(docs.withColumns({f"_k_{c}": F.col(f"`{c}`") for c in docs.columns}), train(docs, labels, text_col=text_col), f"_k_{text_col}")
    return scored.where("predicted = 1").select(*(F.col(f"`_k_{c}`").alias(c) for c in docs.columns))
