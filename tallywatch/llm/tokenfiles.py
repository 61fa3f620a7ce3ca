"""Token ids as flat binary files.

A store is a folder of shards. ``*.bin`` holds the ids of a shard's documents one after the other, as
little-endian unsigned integers of 16 or 32 bits; ``*.off`` holds 64-bit offsets into it (one more than
documents); ``*.ids`` the 64-bit document ids. Shards hold ascending, disjoint ranges of document ids; the
prefix sums of their token counts give the place of each shard in the whole store. Readers map the files.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.llm.common import in_steps

#: Words whose ids a Python worker remembers; it forgets all when it has so many.
KNOWN_WORDS = 1_200_000
_SHARD = "shard int, file string, width int, docs bigint, nulls bigint, tokens bigint"


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others by number from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
_BLANK = _BYTE_CHARS[32]
#: Marks that are tokens of their own after letters, whatever follows the blank behind them.
_MARKS = ".,!|;"


class WordEncoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, word by word.

    The pre-tokenizer never joins anything across a lone blank between two non-blanks, so a text's ids are
    those of its words, each with the blank before it. Words that come again are taken from memory; their ids
    are kept as packed bytes, so a document is one join.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed in the byte order of the machine, which must be little-endian")
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        # Ids of words after a blank, and of words after a line end, which stands in front of their key.
        self.known: dict[str, bytes] = {}
        self.line_end = self.whole(["\n"])[0]
        # Only for a plain byte-level BPE may the text be taken apart.
        split = self.tokenizer.pre_tokenizer
        self.apart = isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str], blank: str = _BLANK) -> list[bytes]:
        """Ids of words of letters only: with or without a blank, each is one token before merging, so the merges alone are asked for."""
        merge, code = self.model.tokenize, self.code
        spelled = (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in words)
        return [array(code, [x.id for x in merge(blank + w)]).tobytes() for w in spelled]

    def learn(self, words: set[str]) -> None:
        """Remember new words. A mark after letters is a token of its own, so such words share the letters."""
        heads = [w for w in words if w[0] == "\n"]
        begun = [w for w in heads if w[1:].isalpha()]
        self.known.update(zip(begun, (self.line_end + x for x in self.letters([w[1:] for w in begun], ""))))
        odd = list(set(heads).difference(begun))
        self.known.update(zip(odd, self.whole(odd)))
        words = words.difference(heads)
        marked = [w for w in words if w[-1] in _MARKS and w[:-1].isalpha()]
        plain = [w for w in words if w.isalpha()]
        # Differences with the dictionary itself: with its keys, all of them would be walked through.
        stems = list({w[:-1] for w in marked}.union(plain).difference(self.known))
        self.known.update(zip(stems, self.letters(stems)))
        marks = dict(zip(_MARKS, self.whole(list(_MARKS))))
        self.known.update((w, self.known[w[:-1]] + marks[w[-1]]) for w in marked)
        rest = list(words.difference(marked, plain))
        self.known.update(zip(rest, self.whole([" " + w for w in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        # A lone line end between two non-blanks is a token of its own, so lines are taken apart too: it goes
        # in front of the word that follows, and one before the text makes its first word such a word.
        keys = {i: ("\n" + x).replace("\n", " \n").split(" ")[1:] for i, x in enumerate(texts) if self.apart and not any(s in x for s in self.special)}
        seen = set().union(*keys.values())
        new = seen.difference(self.known)
        # Known words stand at lone blanks, so only new ones need be looked at.
        pieces = {}
        if loose := {w for w in new if not _tight(w.removeprefix("\n"))}:
            pieces = {i: _words(texts[i]) for i, found in keys.items() if not loose.isdisjoint(found)}
            for i, found in pieces.items():
                keys[i] = [w for w in found[1:] if _tight(w)]
            seen = set().union(*keys.values())
            new = seen.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = seen
        self.learn(new)
        known, skip = self.known.__getitem__, len(self.line_end)
        out: list[bytes | None] = [None] * len(texts)
        for i, found in keys.items():
            out[i] = b"".join(map(known, found))
            if i not in pieces:
                out[i] = out[i][skip:]
        # The first word of such a text, and what ends in white space, is asked for as it stands.
        for i, found in pieces.items():
            first, last = self.whole([found[0], f" {found[-1]}"])
            out[i] = first + out[i] + (last if len(found) > 1 and not _tight(found[-1]) else b"")
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self.whole([texts[i] for i in left])):
            out[i] = x
        return out


def _words(text: str) -> list[str]:
    """Pieces that, joined by blanks, are the text; no blank between two pieces has white space beside it."""
    words = text.split(" ")
    out = [words[0]]
    for w in words[1:]:
        if _tight(w) and out[-1] and not out[-1][-1].isspace():
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}"
    return out


def _tight(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        # A repeated attempt writes files of its own; only those in a returned row belong to the store.
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        end = np.array([end_id], enc.kind).tobytes()
        lengths, ids, nulls = [0], [], 0
        sink = None
        for step, texts in in_steps(batches):
            sink = sink or system.open_output_stream(f"{place}/{name}.bin")
            coded = [x + end for x in enc.encode(texts)]
            sink.write(b"".join(coded))
            lengths += [len(x) // enc.width for x in coded]
            nulls += step.column(0).null_count
            ids += [x or 0 for x in step.column(0).to_pylist()]
        if sink:
            sink.close()
            offsets = np.cumsum(lengths, dtype="<i8")
            for suffix, values in (("off", offsets), ("ids", np.array(ids, "<i8"))):
                with system.open_output_stream(f"{place}/{name}.{suffix}") as out:
                    out.write(values.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"shard": [task.partitionId()], "file": [name], "width": [enc.width], "docs": [len(ids)], "nulls": [nulls], "tokens": [int(offsets[-1])]},
                pa.schema([("shard", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]),
            )

    return write


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the store and return its shards in order, each with ``base``, the tokens of all shards before it.

    Texts are encoded whole, without special tokens; null counts as empty; every document ends with ``end_id``.
    Documents stand in ascending order of id, rows without id first, rows that repeat an id by text. An empty
    table gives a store without shards. Columns other than id and text are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # One row a shard: as many as there are partitions, whatever the size of the corpus.
    shards = sorted(ranged.mapInArrow(_writer(folder, tokenizer, end_id), _SHARD).collect(), key=lambda r: r.shard)
    bases = accumulate((r.tokens for r in shards), initial=0)
    return [r.asDict() | {"base": base} for r, base in zip(shards, bases)]


class Shard:
    """One shard, mapped into memory where the folder is a local path."""

    def __init__(self, folder: str, file: str, width: int, nulls: int):
        self.system, place = opened(folder)
        self.nulls = nulls
        self.stem = f"{place}/{file}"
        self.tokens, self.offsets, self.ids = self._map("bin", f"<u{width}"), self._map("off", "<i8"), self._map("ids", "<i8")

    def _map(self, suffix: str, kind: str) -> np.ndarray:
        path = f"{self.stem}.{suffix}"
        if isinstance(self.system, fs.LocalFileSystem):
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        with self.system.open_input_file(path) as f:
            return np.frombuffer(f.read(), kind)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Document id, offset in the shard, and ids of document ``i``."""
        start, stop = int(self.offsets[i]), int(self.offsets[i + 1])
        return None if i < self.nulls else int(self.ids[i]), start, self.tokens[start:stop]


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_store(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """A row for each document of the store, in its order: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["file"], row["width"], row["nulls"])
                for s in range(0, len(shard), 10_000):
                    found = [shard[i] for i in range(s, min(s + 10_000, len(shard)))]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([x[0] for x in found], pa.int64()), "start": [row["base"] + x[1] for x in found], "n_tokens": [len(x[2]) for x in found], "ids_crc32": [zlib.crc32(x[2].astype("<u4").tobytes()) for x in found]}
                    )

    schema = f"{_SHARD}, base bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    listed = spark.createDataFrame([tuple(x[n] for n in names) for x in shards], schema)
    return listed.repartition(max(1, len(shards)), "shard").mapInArrow(read, _READ)
