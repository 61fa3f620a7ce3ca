"""Secret scan: three fixed patterns, and windows of high Shannon entropy inside candidate strings.

A window of fixed width slides over each candidate string. The counts of its characters are updated by one
character in and one out, and with them the sum of c*log2(c), so a step costs the same for any width. Windows
at or above the threshold of their character class are joined into spans. Parts on the allow-list are skipped, and
windows that are made of words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import append_columns, unused

# Patterns of the three base kinds, and the least length of what they must match.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ["assign", "access", "hex", "entropy"]

#: Runs of HEX are maximal, so only those long enough need be found.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)

#: Character classes of candidate strings: pattern, window width, least entropy in bits.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.1),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
}



def _rest(letters: str) -> str:
    """Pattern of as many of ``letters`` as follow in their order."""
    return "".join(f"(?:{c}" for c in letters) + ")?" * len(letters)


#: Parts of candidate strings that are no secrets: documentation keys, UUIDs, dates, plain sequences. What stands beside them is scanned.
ALLOW = re.compile(
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|AKIA[A-Z0-9]{0,9}EXAMPLE|EXAMPLE"
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|\d{4}-\d\d-\d\d"
    r"|0123456789|abcdefghij" + _rest("klmnopqrstuvwxyz"),
    re.I,
)
#: What remains is no secret without a letter.
_NO_LETTER = re.compile(r"[0-9_=/+-]*")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOWEL = re.compile(r"[aeiouy]", re.I)
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I)
#: A window without a digit is made of words if so much of its letters is in words; a word has so many letters and such a part of vowels.
WORD_PART, WORD_LETTERS, VOWEL_PART = 0.6, 3, 0.25

_STEP = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def made_of_words(window: str) -> bool:
    """Whether a window without a digit looks like words (a path, a name) and not like drawn letters."""
    if _DIGIT.search(window):
        return False
    runs = _WORD.findall(window)
    words = sum(len(x) for x in runs if len(x) >= WORD_LETTERS and len(_VOWEL.findall(x)) >= VOWEL_PART * len(x) and not _CONSONANTS.search(x))
    return words >= WORD_PART * sum(map(len, runs))


def parts(candidate: str) -> list[tuple[int, str]]:
    """(start, text) of what remains of a candidate string without what is on the allow-list."""
    out, at = [], 0
    for m in ALLOW.finditer(candidate):
        out.append((at, candidate[at : m.start()]))
        at = m.end()
    out.append((at, candidate[at:]))
    return [(a, x) for a, x in out if not _NO_LETTER.fullmatch(x)]


def entropy_windows(text: str, width: int, least: float, skip: Callable[[str], bool] | None = None) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``text`` whose entropy is ``least`` or more, without those that ``skip`` holds for."""
    counts: dict[str, int] = {}
    total, spans, top = 0.0, [], math.log2(width) - least
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _STEP[n + 1] - _STEP[n]
        counts[c] = n + 1
        if i >= width:
            out = text[i - width]
            n = counts[out]
            total -= _STEP[n] - _STEP[n - 1]
            counts[out] = n - 1
        # Entropy is log2(width) - total / width.
        if i + 1 >= width and total <= top * width + 1e-9:
            start = i + 1 - width
            if skip and skip(text[start : i + 1]):
                continue
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans the method adds: high-entropy windows, joined over all classes, that no known span covers."""
    found = []
    for pattern, width, least in CLASSES.values():
        for m in pattern.finditer(text):
            for at, part in parts(m[0]):
                if len(part) >= width:
                    found += [(m.start() + at + a, m.start() + at + b) for a, b in entropy_windows(part, width, least, made_of_words)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return [(a, b, 3) for a, b in joined if not any(s <= a and b <= e for s, e, _ in known)]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def all_spans(text: str) -> list[tuple[int, int, int]]:
    known = base_spans(text)
    return sorted(known + entropy_spans(text, known), key=lambda x: (x[0], x[2]))


def find_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end in code points), by start, then kind.

    Base patterns match leftmost without overlap within each kind. "entropy" spans come on top and never
    replace one. Null and empty texts have no spans, repeated rows are all scanned, an empty table gives no
    rows; a column named as ``spans_col`` is replaced, all others stay.
    """

    def scan(texts: list[str]) -> list[pa.Array]:
        return [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in all_spans(x)] for x in texts], _SPANS_ARROW)]

    return append_columns(docs, text_col, [T.StructField(spans_col, _SPANS)], scan)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret of the text replaced by ``mark``; overlapping spans become one. Texts without secrets, null ones too, stay as they are."""

    def clean(texts: list[str]) -> list[pa.Array]:
        return [pa.array([_cut(x, spans, mark) if (spans := all_spans(x)) else None for x in texts], pa.string())]

    redacted = unused("_redacted", docs)
    found = append_columns(docs, text_col, [T.StructField(redacted, T.StringType())], clean)
    return found.select(*(F.coalesce(redacted, F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def _cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
