"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to one numpy step, in bytes.
STEP_CHARS = 1_000_000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where all tasks
    run on this machine, may do without; then a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "tallywatch-llm")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later reads do not repeat its work,
    and a lost executor loses none of it."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def cuts(sizes: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """(start, rows) of steps of rows of at most ``most`` in all; a larger single row is a step of its own."""
    start = size = 0
    for i, n in enumerate([*sizes, most + 1]):
        if i > start and (size + n > most or i == len(sizes)):
            yield start, i - start
            start, size = i, 0
        size += n + 1


def in_steps(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into steps of about ``most`` bytes of text, with their texts (null as empty).

    Only the texts of one step are Python strings at a time; a longer single text is a step of its own.
    """
    for batch in batches:
        for start, rows in cuts(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), most):
            part = batch.slice(start, rows)
            yield part, [x or "" for x in part.column(text).to_pylist()]


def append_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], run: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``docs`` with new columns that ``run`` makes of the whole texts (null as empty), step by step.

    A column that has the name of a new one is replaced; all others pass through unread.
    """
    new = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in new]
    rows = docs.select(F.col(text_col).alias("_text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_steps(batches, text=0):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *run(texts)], names=schema.names)

    out = rows.mapInArrow(step, schema)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), *(f.name for f in fields))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of ``frames`` has it in any case: the name of a helper column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that may be broadcast: about 50 MB as a hash table.
BROADCAST_IDS = 1_000_000


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``gone`` (id, text_hash); null ids match null ids.

    ``gone`` is counted: up to BROADCAST_IDS rows are sent to the documents, more are joined by shuffle. ``docs`` may have columns of any name.
    """
    key, sign = unused("_id", docs), unused("_hash", docs)
    gone = written(gone.select(F.col("id").alias(key), F.col("text_hash").alias(sign)).distinct(), "rows-to-drop")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(key)) & (text_hash(text_col) == F.col(sign))
    return docs.join(gone, same, "left_anti")


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
