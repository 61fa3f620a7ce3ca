"""Hard-negative mining with Four-Russians scoring.

Components are whole numbers. A candidate is kept as bit planes: plane p holds bit p of every component (two's
complement), eight components a byte. An anchor's components are cut into groups of eight, and for each group the
sums of all 256 subsets are made once. One plane's part of an inner product is then a lookup a byte, and the planes
are added with shifts: exact scores without a multiplication.

Candidates stand in blocks, anchors in lots, both packed into one row each; every block meets every lot of its
dimension, as the scores are asked for against all rows. A group of blocks that meet one lot is a task's work, of
bounded size, and only the best of the lot over all of them leaves it. First each anchor's positives are found, then
the negatives whose score lies in the band that each positive sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.ann import matrix
from tallywatch.llm.common import written

#: Bytes of a block of candidates, and of the subset sums of a lot of anchors, on average, and the blocks that a task
#: holds with one lot: together they bound its memory.
BLOCK_BYTES, LOT_BYTES, GROUP_BLOCKS = 1 << 20, 1 << 23, 32
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Larger components (after scaling) could overflow 64-bit scores; rows with one take no part.
LARGEST = 1 << 26

_BLOCK = "dim int, block bigint, ids binary, labels binary, planes binary, n_planes int"
_BLOCK_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("planes", pa.binary()), ("n_planes", pa.int32())])
_LOT = "dim int, lot bigint, keys binary, anchor_ids binary, anchor_labels binary, sums_of binary"
_LOT_ARROW = pa.schema([("dim", pa.int32()), ("lot", pa.int64()), ("keys", pa.binary()), ("anchor_ids", pa.binary()), ("anchor_labels", pa.binary()), ("sums_of", pa.binary())])


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> DataFrame:
    """(id, label, dim, parts): the distinct rows that take part, with whole components.

    Rows with a null id, label, vector or component, with a component that is not finite or of LARGEST or more after
    scaling, or without components take no part.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) if label is None else label).cast("bigint").alias("label"), x.alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
    rows = rows.where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST / SCALE)))
    return rows.select("id", "label", F.size("vector").alias("dim"), F.transform("vector", lambda v: F.floor(v * SCALE).cast("int")).alias("parts")).distinct()


def bit_planes(parts: np.ndarray, n_planes: int) -> np.ndarray:
    """(planes, groups of eight, rows) bytes of the two's complement of ``parts`` (rows, dim)."""
    bits = (parts[None] >> np.arange(n_planes)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1)


def subset_sums(parts: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256): the sum of the components that each byte marks, for every group of eight."""
    n, dim = parts.shape
    groups = np.zeros((n, -(-dim // 8) * 8), np.int64)
    groups[:, :dim] = parts
    groups = groups.reshape(n, -1, 8)
    sums = np.zeros((n, groups.shape[1], 256), np.int64)
    for k in range(8):
        sums[:, :, 1 << k : 2 << k] = sums[:, :, : 1 << k] + groups[:, :, k : k + 1]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of one anchor (groups, 256) with all rows of ``planes`` (planes, groups, rows), by lookups and shifts."""
    total = np.zeros(planes.shape[2], np.int64)
    for p in range(len(planes) - 1, -1, -1):
        part = sum(sums[g].take(planes[p, g]) for g in range(planes.shape[1]))
        # The top plane is that of the sign.
        total = -part if p == len(planes) - 1 else (total << 1) + part
    return total


def _total(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum("dim"), F.lit(0)).cast("bigint")).first()[0]


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Candidates packed into ``blocks`` rows a dimension, each by ascending id."""

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        parts = matrix(table.column("parts").combine_chunks(), dim).astype(np.int64)
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        # One bit more than the largest magnitude needs, for the sign.
        n_planes = int(max(parts.max(), -1 - parts.min(), 0)).bit_length() + 1
        planes = np.ascontiguousarray(bit_planes(parts[order], n_planes))
        row = [dim, table.column("block")[0].as_py(), ids[order].tobytes(), labels[order].tobytes(), planes.tobytes(), n_planes]
        return pa.table([[x] for x in row], schema=_BLOCK_ARROW)

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "parts"), F.lit(blocks)))
    return written(keyed.groupBy("dim", "block").applyInArrow(pack, _BLOCK), "negative-blocks")


def _lots(anchors: DataFrame, lots: int) -> DataFrame:
    """Anchors packed into ``lots`` rows a dimension."""

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        parts = matrix(table.column("parts").combine_chunks(), dim).astype(np.int32)
        row = [dim, table.column("lot")[0].as_py(), *(table.column(c).to_numpy().tobytes() for c in ("key", "id", "label")), parts.tobytes()]
        return pa.table([[x] for x in row], schema=_LOT_ARROW)

    return written(anchors.withColumn("lot", _lot(lots)).groupBy("dim", "lot").applyInArrow(pack, _LOT), "anchor-lots")


def _lot(lots: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit("lot")), F.lit(lots))


def _meet(blocks: DataFrame, lots: DataFrame, n_blocks: int, n_lots: int) -> DataFrame:
    """Each block with each lot of its dimension, and the ``slot`` of those that a task takes together: GROUP_BLOCKS, fewer where cores would be idle."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    slots = max(-(-n_blocks // GROUP_BLOCKS), min(n_blocks, -(-2 * cores // n_lots)))
    met = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_lots - 1).cast("bigint")))).join(lots, ["dim", "lot"])
    return met.withColumn("slot", F.pmod("block", F.lit(slots)))


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _first(found: list[list[np.ndarray]], n_keys: int, k: int) -> list[np.ndarray]:
    """Of columns (keys..., id, score) the first ``k`` rows of each key, by score descending, then id."""
    columns = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort([columns[-2], -columns[-1], *columns[n_keys - 1 :: -1]] if n_keys else [columns[-2], -columns[-1]])
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[1:] != x[:-1] for x in columns[:n_keys]], axis=0)
    starts = np.flatnonzero(new)
    kept = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k
    return [x[kept] for x in columns]


def _scan(met: DataFrame, picks: Callable, names: list[str], n_keys: int, k: int) -> DataFrame:
    """Rows that ``picks`` chooses of every block and anchor, cut to the first ``k`` of a key within a task."""
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(table: pa.Table) -> pa.Table:
        held: list[list[np.ndarray]] = []
        lot = table.slice(0, 1).to_pylist()[0]
        sums = subset_sums(np.frombuffer(lot["sums_of"], np.int32).reshape(-1, lot["dim"]))
        keys, owns, kinds = _long(lot["keys"]), _long(lot["anchor_ids"]), _long(lot["anchor_labels"])
        positives = dict(lot.get("positives") or [])
        for i in range(table.num_rows):
            row = table.select(["ids", "labels", "planes", "n_planes"]).slice(i, 1).to_pylist()[0]
            ids, labels = _long(row["ids"]), _long(row["labels"])
            planes = np.frombuffer(row["planes"], np.uint8).reshape(row["n_planes"], -1, len(ids)).astype(np.intp)
            for key, own, kind, sum_table in zip(keys.tolist(), owns.tolist(), kinds.tolist(), sums):
                held += picks(scores(sum_table, planes), ids, labels, key, own, kind, positives)
            held = [_first(held, n_keys, k)] if held else []
        return pa.table(held[0] if held else [[]] * len(names), schema=schema)

    return met.groupBy("dim", "lot", "slot").applyInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _top(found: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of ``rows``, by score descending, then by place (rows stand by ascending id)."""
    if len(rows) > k:
        least = np.partition(found[rows], len(rows) - k)[len(rows) - k]
        rows = rows[found[rows] >= least]
    return rows[np.argsort(-found[rows], kind="stable")[:k]]


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are ``floor(256 * x)``, the score of a row is its inner product with the anchor; higher scores come
    first, ties by smaller id. ``anchors`` says over the column ``id`` which rows are anchors. An anchor's positives
    are its first ``positives`` other rows of its label; for each of them, the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned, all if fewer.

    Rows of ``quantised`` take part: whole repeated rows count once, other columns are ignored; a row of an anchor's
    own id is never its positive; rows of one id with different vectors are rows of their own, as anchors too. Only
    rows with as many components are compared. An anchor without positives, or without rows in the band, has no row;
    an empty table gives none. ``label`` replaces the label column.
    """
    usable = written(quantised(rows, id_col, vector_col, label_col, label), "quantised")
    asked = written(usable.where(anchors).withColumn("key", F.xxhash64("id", "label", "parts")), "anchors")
    n_blocks = max(1, -(-2 * _total(usable) // BLOCK_BYTES))
    n_lots = max(1, -(-256 * _total(asked) // LOT_BYTES))
    blocks, lots = _blocks(usable, n_blocks), _lots(asked, n_lots)

    def nearest(found, ids, labels, key, own, label, _) -> list[list[np.ndarray]]:
        kept = _top(found, ids, np.flatnonzero((labels == label) & (ids != own)), positives)
        return [[np.full(len(kept), key), np.full(len(kept), own), ids[kept], found[kept]]]

    names = ["key", "anchor_id", "positive_id", "positive_score"]
    found = _scan(_meet(blocks, lots, n_blocks, n_lots), nearest, names, 2, positives)
    best = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    found = written(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= positives).drop("_r"), "positives")

    # A lot's positives go with it: for each anchor key, its pairs (id, score).
    wanted = found.join(asked.select("key", "dim"), "key").groupBy("dim", _lot(n_lots).alias("lot"), "key").agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("list"))
    wanted = wanted.groupBy("dim", "lot").agg(F.map_from_entries(F.collect_list(F.struct("key", "list"))).alias("positives"))

    def in_band(found, ids, labels, key, own, label, lists) -> list[list[np.ndarray]]:
        out, other = [], None
        for pair in lists.get(key, ()):
            score = pair["positive_score"]
            most, least = high * score // 100, -(-low * score // 100)
            if most < least:
                continue
            if other is None:
                other = np.flatnonzero(labels != label)
                values = found[other]
            kept = _top(found, ids, other[(values >= least) & (values <= most)], negatives)
            n = len(kept)
            out.append([np.full(n, key), np.full(n, own), np.full(n, pair["positive_id"]), np.full(n, score), ids[kept], found[kept]])
        return out

    names = ["key", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    result = _scan(_meet(blocks, lots.join(wanted, ["dim", "lot"]), n_blocks, n_lots), in_band, names, 4, negatives)
    order = Window.partitionBy("key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    result = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
