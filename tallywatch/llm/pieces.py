"""SentencePiece encoding and decoding with a Viterbi that shares prefixes.

A text is marked (blanks become U+2581, one is put in front) and cut before each run of marks; no piece of the
vocabulary reaches across such a cut, so the best segmentation of a text is that of its words. The distinct words
of a step are sorted, which is a depth-first walk through their trie: forward scores and back pointers of the
prefix that a word shares with the one before it stand already, and only the rest is computed. Words of usual length
are taken many at a time, place by place, in numpy; a prefix that neighbours share is still computed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import cuts

MARK = "▁"
#: Words met in several steps whose ids a Python worker remembers, and words met in one step only; beyond, old ones are forgotten.
KNOWN_WORDS, NEW_WORDS = 40_000, 30_000
#: Words up to so many characters are searched together, so many at a time.
SHORT_WORD, SLAB_WORDS = 32, 16_384
#: Bytes of an Arrow batch: a step of text and its ids, not 10,000 whole texts.
BATCH_BYTES = 4_000_000
#: A BPE model has merge ranks, no probabilities: a piece of rank r scores -ln(r + 2) - PIECE_COST.
PIECE_COST = 6.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Code points that are no characters: one that a text lacks stands for a U+2581 in it.
_STAND_INS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


class Pieces:
    """Vocabulary of a SentencePiece model file: score and id of each piece, and the ids of the 256 bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        names = [model.id_to_piece(i) for i in size]
        scores = np.array([model.get_score(i) for i in size])
        if len({float(s) for s in scores[plain]} & {float(-r) for r in range(1000)}) > 900:  # whole ranks: a BPE model
            scores = -np.log(np.minimum(-scores, len(names)) + 2) - PIECE_COST
        self.pieces = {names[i]: (float(scores[i]), i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown_score = min(s for s, _ in self.pieces.values()) - 10
        # Trie of the pieces read backwards; the empty key of a node holds score and id of the piece that ends there.
        self.endings: dict = {}
        for name, found in self.pieces.items():
            node = self.endings
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[""] = found
        self._as_arrays()
        self.content = [b""] * len(names)
        for i in plain:
            self.content[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.content[i] = bytes([b])

    def _as_arrays(self) -> None:
        """The same trie by numbers: characters of the vocabulary in order, children by (node, character), score and id of the nodes."""
        self.chars = np.array(sorted({ord(c) for name in self.pieces for c in name}), np.int32)
        place = {c: i for i, c in enumerate(self.chars.tolist())}
        edges, found, waiting = {}, [], [self.endings]
        # Breadth first: a node is numbered when it is put into the row.
        for at, node in enumerate(waiting):
            found.append(node.get("", (-np.inf, -1)))
            for c, child in node.items():
                if c:
                    edges[at * (len(place) + 1) + place[ord(c)]] = len(waiting)
                    waiting.append(child)
        # A last key that is never looked for, so that every search ends inside.
        keys = np.array([*edges, np.iinfo(np.int64).max])
        order = np.argsort(keys)
        self.edges, self.children = keys[order], np.array([*edges.values(), -1])[order]
        self.node_score, self.node_id = np.array([s for s, _ in found]), np.array([i for _, i in found], np.int32)
        #: The node of each character alone; -1 for one that ends no piece or is in none.
        self.last_nodes = np.array([edges.get(i, -1) for i in range(len(place) + 1)])

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece: its bytes, or the unknown id if the model has none."""
        return [self.bytes.get(b, self.unknown_id) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown_id]


def viterbi(words: list[str], pieces: Pieces, spell: Callable[[str], list[int]] | None = None) -> list[list[int]]:
    """Ids of the segmentation of the highest score of each of the sorted ``words``; of equal ones, the longest last piece wins."""
    spell = spell or pieces.fallback
    root, unknown = pieces.endings, pieces.unknown_score
    best, back, last = [0.0], [(0, -1)], ""
    out = []
    for word in words:
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, came = best[end - 1] + unknown, (end - 1, -1)
            node, start = root, end
            while start:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                found = node.get("")
                if found and best[start] + found[0] >= top:
                    top, came = best[start] + found[0], (start, found[1])
            best.append(top)
            back.append(came)
        last = word
        ids: list[int] = []
        end = len(word)
        while end:
            start, i = back[end]
            if i < 0:
                ids += reversed(spell(word[start:end]))
            else:
                ids.append(i)
            end = start
        out.append(ids[::-1])
    return out


def short_viterbi(words: list[str], pieces: Pieces) -> list[bytes]:
    """What ``viterbi`` finds, as packed ids, for sorted words of SHORT_WORD characters or fewer: all words a place at a time.

    The distinct prefixes of a length are numbered in order; each has its parent, its last character, score and back pointer.
    """
    if not words:
        return []
    n, width = len(words), len(pieces.chars)
    length = np.fromiter(map(len, words), np.int64, n)
    longest = int(length.max())
    inside = np.arange(1, longest + 1)[:, None] <= length
    text = np.zeros((n, longest), np.int32)
    text[inside.T] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<i4")
    text = np.ascontiguousarray(text.T)
    # Whether a word shares its first characters, so many, with the word before it.
    shares = np.zeros((longest, n), bool)
    shares[:, 1:] = np.logical_and.accumulate(inside[:, 1:] & inside[:, :-1] & (text[:, 1:] == text[:, :-1]))
    number = np.zeros((longest + 1, n), np.int32)
    parent, letter, best, back, ids = [None], [None], [np.zeros(1)], [np.zeros(1, np.int8)], [np.full(1, -1, np.int32)]
    for end in range(1, longest + 1):
        own = inside[end - 1] & ~shares[end - 1]
        mine = np.flatnonzero(own)
        np.cumsum(own, out=number[end])
        number[end] -= 1
        codes = text[end - 1, mine]
        at = np.minimum(np.searchsorted(pieces.chars, codes), width - 1)
        letter.append(np.where(pieces.chars[at] == codes, at, width))
        parent.append(number[end - 1, mine])
        top = best[-1][parent[end]] + pieces.unknown_score
        came, piece = np.full(len(mine), end - 1, np.int8), np.full(len(mine), -1, np.int32)
        rows = before = np.arange(len(mine))
        for start in range(end - 1, -1, -1):
            last = letter[start + 1][before]
            if start == end - 1:
                node = pieces.last_nodes[last]
                goes = node >= 0
                node = node[goes]
            else:
                # A character that is in no piece has a number of its own, beyond those of the vocabulary.
                key = node * (width + 1) + last
                place = np.searchsorted(pieces.edges, key)
                goes = pieces.edges[place] == key
                node = pieces.children[place[goes]]
            rows = rows[goes]
            if not len(rows):
                break
            before = parent[start + 1][before[goes]]
            score = best[start][before] + pieces.node_score[node]
            wins = score >= top[rows]
            won = rows[wins]
            top[won], came[won], piece[won] = score[wins], start, pieces.node_id[node[wins]]
        best.append(top)
        back.append(came)
        ids.append(piece)
    first = np.cumsum([0, *map(len, ids)])
    ids, back = np.concatenate(ids), np.concatenate(back)
    out, cut = np.full((n, longest), -1, np.int32), np.zeros((n, longest), np.int8)
    place, count, spelled = length.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    on = np.flatnonzero(place)
    while len(on):
        at = first[place[on]] + number[place[on], on]
        found, start = ids[at], back[at]
        spelled[on[found < 0]] = True
        count[on] += 1
        out[on, longest - count[on]], cut[on, longest - count[on]] = found, start
        place[on] = start
        on = on[start > 0]
    packed = out[np.arange(longest) >= longest - count[:, None]].astype("<i4").tobytes()
    ends = 4 * np.cumsum(count)
    result = [packed[a:b] for a, b in zip((ends - 4 * count).tolist(), ends.tolist())]
    for i in np.flatnonzero(spelled).tolist():
        steps = zip(out[i, longest - count[i] :].tolist(), cut[i, longest - count[i] :].tolist())
        result[i] = np.array([x for found, start in steps for x in (pieces.fallback(words[i][start]) if found < 0 else (found,))], "<i4").tobytes()
    return result


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # Words met in several steps, those of them not met lately, and words met in one step only.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def _computed(self, words: set[str]) -> dict[str, bytes]:
        """The packed ids of words, each searched for once."""
        fresh, long = sorted(w for w in words if len(w) <= SHORT_WORD), sorted(w for w in words if len(w) > SHORT_WORD)
        ids = dict(zip(long, (np.array(x, "<i4").tobytes() for x in viterbi(long, self.pieces))))
        for start in range(0, len(fresh), SLAB_WORDS):
            slab = fresh[start : start + SLAB_WORDS]
            ids.update(zip(slab, short_viterbi(slab, self.pieces)))
        return ids

    def _ids(self, seen: set[str]) -> dict[str, bytes]:
        """The packed ids of the words of a step."""
        # Differences with the dictionaries themselves: with their keys, all of them would be walked through.
        new = seen.difference(self.known)
        ids = {w: self.known[w] for w in seen if w in self.known}
        again = {w: self.older[w] for w in new if w in self.older} | {w: self.once.pop(w) for w in new if w in self.once}
        fresh = self._computed(new.difference(again))
        if len(self.known) + len(again) > KNOWN_WORDS // 2:
            self.older, self.known = self.known, {}
        self.known.update(again)
        if len(self.once) + len(fresh) > NEW_WORDS:
            self.once = {}
        self.once.update(fresh)
        return ids | again | fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        parts = [None if MARK in x else _WORD.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        ids = self._ids(set().union(*(p for p in parts if p))).__getitem__
        return [self._with_marks(x) if p is None else b"".join(map(ids, p)) for x, p in zip(texts, parts)]

    def _with_marks(self, text: str) -> bytes:
        """A text that holds U+2581 itself, which is spelled in bytes so that it is not decoded as a blank."""
        other = next((c for c in _STAND_INS if c not in text), None)
        if other is None:
            # Texts with all stand-ins too: any code point that it lacks will do.
            used = set(text)
            other = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in used)
        words = _WORD.findall(MARK + text.replace(MARK, other).replace(" ", MARK))
        fresh = sorted(set(words))
        ids = dict(zip(fresh, viterbi(fresh, self.pieces, lambda c: self.pieces.fallback(MARK if c == other else c))))
        return np.array([i for w in words for i in ids[w]], "<i4").tobytes()


def _small_batches(spark: SparkSession) -> None:
    """Rows go to the workers and back some megabytes at a time, however long they are; a session that wants less keeps its setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name).lower().removesuffix("b")
    if not had.isdigit() or not 0 < int(had) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_HELD: dict[str, Encoder] = {}


def _encoder(path: str, pieces: Pieces) -> Encoder:
    """One encoder a worker and vocabulary, so that words are remembered from task to task."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Encoder(pieces)
    return _HELD[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text (an array of ints).

    Null and empty texts have no ids. No normalization is done, so decoding gives back the text; that needs a
    model with byte pieces where a character has no piece (else it becomes the unknown id). Rows that repeat are
    encoded alike; a column named as ``ids_col`` is replaced, others stay; an empty table gives no rows.
    """
    _small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))  # the size of the vocabulary, whatever the corpus

    kept = [f for f in docs.schema.fields if f.name != ids_col]
    source = docs.select(F.col(f"`{text_col}`").alias("_text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def ids_of(texts: pa.Array) -> pa.Array:
        coded = _encoder(path, shared.value).encode([x or "" for x in texts.to_pylist()])
        offsets = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))

    def step(batches):
        for batch in batches:
            for start, rows in cuts(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids_of(part.column(0))], names=schema.names)
                del part
            # Only one batch of texts stands in a worker: the next is read when this one is gone.
            del batch
            pa.default_memory_pool().release_unused()

    out = source.mapInArrow(step, schema)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), ids_col)


def decode(rows: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids and ids outside the vocabulary count as nothing, bytes that are no UTF-8 as U+FFFD."""
    _small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(path).content)

    kept = [f for f in rows.schema.fields if f.name != out_col]
    source = rows.select(F.col(ids_col).alias("_ids"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(out_col, T.StringType())])

    def step(batches):
        content = shared.value
        size = len(content)
        for batch in batches:
            # An id stands for about four characters.
            for start, rows in cuts([4 * n for n in pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_pylist()]):
                part = batch.slice(start, rows)
                texts = []
                for ids in part.column(0):
                    values = ids.values.drop_null().to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                    values = values[(values >= 0) & (values < size)].tolist()
                    texts.append(b"".join(map(content.__getitem__, values))[1:].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=schema.names)
                del part, texts
            del batch
            pa.default_memory_pool().release_unused()

    out = source.mapInArrow(step, schema)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), out_col)
