"""Removal of repeated byte strings across documents.

A string of LENGTH bytes that starts at two places is removed from both. Its copies are brought together by
content: of the GRAM-byte substrings of a window of LENGTH bytes, the one with the smallest hash (the first of
equal ones) is the window's anchor. Equal windows have equal anchors at equal offsets, so only windows whose
anchors hash alike need be compared, each window belongs to one anchor, and no pair of documents is formed.

The segments around equal anchors, laid on each other at the anchor, are a collection of short strings. Their
sorted order is built column by column from the right: each round puts one more byte in front of every segment,
sorts stably by it, and updates the common prefix lengths of neighbours. (This is the positional form of the
column-wise construction of a collection's Burrows-Wheeler transform: as segments are aligned, only suffixes
of the same column are ever compared.) A window is repeated if a neighbour in the order of its column shares
LENGTH bytes.

Texts that are equal as a whole are one class, and only one member of it takes part. A group of segments beyond
GROUP_ROWS is taken apart by more of its content until its parts are small or agree in all LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import in_steps, written

LENGTH, GRAM = 200, 32
#: Segments that one construction takes at once (some 30 MB of columns).
GROUP_ROWS = 32_768
#: A longer text is read in blocks of so many window starts.
BLOCK = 1 << 22
#: Spans that may be broadcast to the texts (some 30 MB); more are joined by shuffle.
BROADCAST_SPANS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.uint64((1 << 28) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of ``data`` by running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(pow(int(_BASE), -1, 1 << 64), n)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.inverse) - size + 1
        return self._mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def parts(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts that stand one after the other in ``data``: the text, the anchor's hash and place, the first and the
    number of the window starts of each anchor, and a hash of the bytes of all its windows (places in ``data``). Texts
    below ``length`` bytes have none."""
    ends = np.r_[starts[1:], len(data)]
    if not (ends - starts >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
    all_hashes = Hashes(data)
    hashes = all_hashes.grams(gram)
    n = len(hashes)
    least = (hashes & ~_PLACES) | np.arange(n, dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach : n - reach + 1])
    # Window starts that lie with their whole window in one text.
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    place = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    anchor = (least[place] & _PLACES).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first, n = place[new], np.diff(np.r_[new, len(place)])
    return owner[new], hashes[anchor[new]], anchor[new], first, n, all_hashes.parts(first, first + n - 1 + length)


def told_apart(data: bytes, key: np.ndarray, low: np.ndarray, first: np.ndarray, n: np.ndarray, digest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which segments of one step are the first of their kind, and which have an equal one in the step (compared byte by byte)."""
    order = np.lexsort((first, digest, n, low, key))
    same = np.r_[False, (key[order][1:] == key[order][:-1]) & (low[order][1:] == low[order][:-1]) & (n[order][1:] == n[order][:-1]) & (digest[order][1:] == digest[order][:-1])]
    leader, repeated = np.ones(len(key), bool), np.zeros(len(key), bool)
    head = 0
    for i, again in zip(order.tolist(), same.tolist()):
        if not again:
            head = i
        elif data[first[i] : first[i] + n[i] - 1 + length] == data[first[head] : first[head] + n[head] - 1 + length]:
            leader[i] = False
            repeated[i] = repeated[head] = True
    return leader, repeated


def _joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (sorted by row and start, stops rising) with those that touch made one."""
    if not len(row):
        return row, start, stop
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])])
    return row[new], start[new], stop[np.r_[new[1:] - 1, len(row) - 1]]


def repeated_windows(columns: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which windows of aligned segments occur twice in their group: a row for each segment, a column for each start.

    ``columns`` holds the bytes column by column (a row of it is one column of all segments), 256 where a segment
    has none; ``groups`` is sorted; the windows of segment i start at columns ``low[i]`` to ``high[i]``.
    """
    width, n = columns.shape
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # bytes that a row of the order shares with the one before it, so far
    out = np.zeros((n, width - length + 1), bool)
    for c in range(width - 1, -1, -1):
        # One byte in front of every segment: a stable sort by (group, byte) of the order that stands.
        key = groups[order] * 512 + columns[c][order]
        place = np.argsort(key, kind="stable")
        key, order = key[place], order[place]
        same = np.r_[False, (key[1:] == key[:-1]) & (key[1:] % 512 < 256)]
        # Two rows that are neighbours now share one byte more than the least of what lay between them before.
        left, right = place[:-1][same[1:]] + 1, place[1:][same[1:]] + 1
        bounds = np.empty(2 * len(left), np.int64)
        bounds[::2], bounds[1::2] = left, right
        fresh = np.zeros(n + 1, np.int32)
        if len(left):
            fresh[:n][same] = np.minimum(np.minimum.reduceat(common, bounds)[::2] + 1, length)
        common = fresh
        if c <= width - length:
            full = (common[:n] >= length) | (common[1:] >= length)
            rows = order[full]
            out[rows[(low[rows] <= c) & (c <= high[rows])], c] = True
    return out


def _matrix(segments: list[bytes], low: np.ndarray, width: int) -> np.ndarray:
    sizes = np.array([len(x) for x in segments])
    out = np.full((width, len(segments)), 256, np.int16)
    row = np.repeat(np.arange(len(segments)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.repeat(low, sizes)
    out[at, row] = np.frombuffer(b"".join(segments), np.uint8)
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


_CLASS = "a bigint, bytes bigint"
_SEGMENT = f"key bigint, {_CLASS}, start bigint, low int, n int, part binary"
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]
_SPAN = f"{_CLASS}, start bigint, stop bigint"


def text_class() -> list[Column]:
    """A text's hash and its length in bytes: they tell texts apart."""
    return [F.xxhash64("text").alias("a"), F.octet_length("text").cast("bigint").alias("bytes")]


def _blocks(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for s in range(0, max(1, len(data) - length + 1), BLOCK):
        yield s, data[s : s + BLOCK + length - 1]


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, texts in in_steps(batches, text=2):
            a, size = step.column(0).to_numpy(), step.column(1).to_numpy()
            parts = [(i, s, part) for i, x in enumerate(texts) for s, part in _blocks(x.encode(), length)]
            owner, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts], np.int64)
            starts = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
            data = b"".join(p[2] for p in parts)
            text, key, anchor, first, n, digest = anchors(np.frombuffer(data, np.uint8), starts, length, gram)
            low = first - anchor + length - gram
            # Equal segments of one step (periodic stretches, near copies) are settled here; one of them stands for all.
            leader, repeated = told_apart(data, key, low, first, n, digest, length)
            move = (base - starts)[text] if len(text) else np.zeros(0, np.int64)
            row, start, stop = _joined(text[repeated], (first + move)[repeated], (first + move + n - 1 + length)[repeated])
            yield _places(a[owner[text[leader]]], size[owner[text[leader]]], (first + move)[leader], n[leader], key[leader].view(np.int64), low[leader])
            if len(row):
                yield _places(a[owner[row]], size[owner[row]], start, stop - start, None, np.zeros(len(row), np.int64))

    return run


def _places(a: np.ndarray, size: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray | None, low: np.ndarray) -> pa.RecordBatch:
    keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())
    return pa.RecordBatch.from_arrays([keys, pa.array(a), pa.array(size), pa.array(start, pa.int64()), pa.array(low, pa.int32()), pa.array(n, pa.int32())], names=_NAMES[:6])


def _cut_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, texts in in_steps(batches, text=2):
            found = step.column(3).to_pylist()
            rows = []
            for a, size, text, windows in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), texts, found):
                data = text.encode()
                rows += [(w["key"], a, size, w["start"], w["low"], w["n"], data[w["start"] : w["start"] + w["n"] - 1 + length]) for w in windows]
            for s in range(0, len(rows), 20_000):
                columns = zip(*rows[s : s + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ARROW)], names=_NAMES)

    return run


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _compare(length: int, gram: int, most: int):
    """Spans of the repeated windows, for rows sorted by key, class and start; groups are taken together up to ``most`` rows."""
    width = 2 * length - gram

    def judge(table: pa.Table) -> pa.RecordBatch:
        key, a, size, start, low, n = (table.column(i).to_numpy() for i in range(6))
        # The same place may come twice if a whole row of the table is repeated.
        new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (size[1:] != size[:-1]) | (start[1:] != start[:-1])]
        kept = np.flatnonzero(new)
        key, a, size, start, low, n = (x[kept] for x in (key, a, size, start, low, n))
        parts = table.column(6).take(pa.array(kept)).to_pylist()
        groups = np.cumsum(np.r_[0, key[1:] != key[:-1]]).astype(np.int64)
        flags = repeated_windows(_matrix(parts, low, width), groups, low, low + n - 1, length)
        row, first, last = _runs(flags)
        return pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(size[row]), pa.array(start[row] + first - low[row]), pa.array(start[row] + last - low[row] + length)], names=["a", "bytes", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for s in range(0, batch.num_rows, most):
                held.append(batch.slice(s, most))
                rows += held[-1].num_rows
                if rows >= most:
                    table = pa.Table.from_batches(held).combine_chunks()
                    keys = table.column(0).to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                    if cut:
                        yield judge(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = len(table) - cut
        if rows:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    return run


def _split(length: int, gram: int, from_: int, to: int):
    """Rows of segments whose windows start in columns ``from_`` to ``to``, for each half of that range, keyed by the bytes that all windows of the half share."""
    middle = (from_ + to) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, a, size, start, low, n, part in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for half, (x, y) in enumerate(((from_, middle), (middle + 1, to))):
                    first, last = max(low, x), min(low + n - 1, y)
                    if first <= last:
                        shared = part[max(0, y - low) : max(0, x + length - low)]
                        digest = hashlib.blake2b(shared, digest_size=8, key=(key % (1 << 64)).to_bytes(8, "little") + bytes([half])).digest()
                        rows.append((int.from_bytes(digest, "little", signed=True), a, size, start + first - low, first, last - first + 1, part[first - low : last - low + length]))
            for s in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[s : s + 20_000]), _ARROW)], names=_NAMES)

    return run


def _sized(segments: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Segments of groups with two rows up to ``most``, and of larger groups."""
    sizes = segments.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = segments.join(sizes, "key")
    return met.where(F.col("size") <= most).drop("size"), met.where(F.col("size") > most).drop("size")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of ``docs`` (doc_id, text; text not null): (a, bytes, copies, doc_id of one member), and the spans of
    windows that they share with other classes or hold twice: (a, bytes, start, stop), which may overlap."""
    classed = docs.select("doc_id", "text", *text_class())
    classes = written(classed.groupBy("a", "bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")), "text-classes")
    places = classed.where(F.col("bytes") >= length).select("a", "bytes", "text").mapInArrow(_find_anchors(length, gram), f"key bigint, {_CLASS}, start bigint, low int, n int")
    places = written(places, "anchors")
    settled = places.where("key IS NULL").select("a", "bytes", "start", (F.col("start") + F.col("n")).alias("stop"))
    places = places.where("key IS NOT NULL")
    keys = places.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = places.join(keys.select("key"), "key").groupBy("a", "bytes").agg(F.collect_set(F.struct("key", "start", "low", "n")).alias("windows"))
    members = shared.join(classes, ["a", "bytes"]).select("a", "bytes", F.col("one").alias("doc_id"), "windows")
    # One member of each class carries the text; its id keeps the copies of a hot text apart.
    same = [F.col("t.a") == F.col("m.a"), F.col("t.bytes") == F.col("m.bytes"), F.col("t.doc_id").eqNullSafe(F.col("m.doc_id"))]
    texts = classed.alias("t").join(members.alias("m"), same).select("t.a", "t.bytes", "t.text", "m.windows")
    compare = _compare(length, gram, group_rows)

    def judged(segments: DataFrame) -> DataFrame:
        return segments.repartition("key").sortWithinPartitions("key", "a", "bytes", "start").mapInArrow(compare, _SPAN)

    hot = keys.where(F.col("rows") > group_rows).select("key")
    cut = _cut_segments(length)
    if not hot.take(1):
        return classes, settled.unionByName(judged(texts.mapInArrow(cut, _SEGMENT)))
    segments = written(texts.mapInArrow(cut, _SEGMENT), "segments")
    few, many = _sized(segments, group_rows)
    found = [settled, judged(few)]
    ranges = [(0, length - gram, written(many, "segments"))]
    while ranges:
        low, high, rows = ranges.pop()
        if low == high:  # all bytes of the window are in the key, and compared below once more
            whole = rows.groupBy("part").agg(F.count_distinct("a", "bytes", "start").alias("n")).where("n > 1")
            found.append(rows.join(whole.drop("n"), "part").select("a", "bytes", "start", (F.col("start") + length).alias("stop")))
            continue
        halves = written(rows.mapInArrow(_split(length, gram, low, high), _SEGMENT), "segments")
        few, many = _sized(halves, group_rows)
        found.append(judged(few))
        many = written(many, "segments")
        middle = (low + high) // 2
        for x, y in ((low, middle), (middle + 1, high)):
            part = many.where(F.col("low").between(x, y))
            if part.take(1):
                ranges.append((x, y, part))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return classes, spans


_LISTED = f"{_CLASS}, spans array<struct<start:bigint,stop:bigint>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found in batch.column(2).to_pylist():
            joined: list[dict] = []
            for x in sorted(found, key=lambda x: (x["start"], x["stop"])):
                if joined and x["start"] <= joined[-1]["stop"]:
                    joined[-1]["stop"] = max(joined[-1]["stop"], x["stop"])
                else:
                    joined.append(x)
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(2).type)], names=["a", "bytes", "spans"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step, texts in in_steps(batches, text=2):
        spans = [[(x["start"], x["stop"]) for x in found] for found in step.column(3).to_pylist()]
        kept = []
        for text, found in zip(texts, spans):
            data = text.encode()
            kept.append(b"".join(data[a:b] for (_, a), (b, _) in zip([(0, 0), *found], [*found, (len(data), 0)])))
        yield pa.RecordBatch.from_arrays(
            [step.column(0), step.column(1), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(kept, pa.binary())],
            names=["a", "bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each document (doc_id, n_bytes, n_removed, n_spans, kept_sha256): what is left of its UTF-8 bytes when each
    byte of a ``length``-byte string that starts anywhere else too is removed. Spans are maximal removed runs.

    Strings never cross documents, may overlap and are judged on the input. Null counts as empty; texts shorter than
    ``length`` stay whole. Rows that repeat a text, with the same id or another, are copies of each other. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes, spans = repeated_spans(rows, length, gram, group_rows)
    single = classes.where("copies = 1").select("a", "bytes")
    listed = spans.groupBy("a", "bytes").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).join(single, ["a", "bytes"])
    listed = written(listed.select("a", "bytes", "spans").mapInArrow(_merged, _LISTED), "spans")
    if (listed.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        listed = F.broadcast(listed)
    changed = rows.select("text", *text_class()).join(listed, ["a", "bytes"]).select("a", "bytes", "text", "spans")
    left = changed.mapInArrow(_removed, f"{_CLASS}, n_removed bigint, n_spans bigint, kept binary").select("a", "bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    copies = classes.where((F.col("copies") > 1) & (F.col("bytes") >= length)).select(
        "a", "bytes", F.col("bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256")
    )
    base = rows.select("doc_id", *text_class(), F.sha2("text", 256).alias("whole_sha256"))
    zero = F.lit(0).cast("bigint")
    return base.join(left.unionByName(copies), ["a", "bytes"], "left").select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )
