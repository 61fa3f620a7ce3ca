"""Nearest neighbours with randomly rotated one-bit codes.

Every vector is moved by a centre, scaled to length one, rotated by a random orthogonal matrix and
kept as its signs: one packed bit a component. Two numbers go with the code: the length of the moved
vector and the inner product of the unit vector with its own code. With them the inner product of a
query and a vector is estimated from the bits alone, without bias, and the estimate has an error bound.
Vectors are compared exactly in the order of their least possible distances, some at a time; a vector whose least possible
distance is above the k-th exact distance found so far is left out. The bound holds with the probability that its width gives.

Queries and vectors meet in blocks: rows of either table get a block number by the hash of their id, each
pair of blocks is one group of bounded size, and each group returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of one block; together they bound the memory of a task. Every vector is sent once for each block of queries.
BLOCK_ROWS, QUERY_ROWS = 32_768, 16_384
#: Vectors that the centre of the codes is taken from. Every vector is indexed; only the centre is fitted.
CENTRE_ROWS = 4_096
#: Width of the error bound in standard errors of the estimate.
EPSILON = 3.0
#: Vectors compared in each round before the limit is taken anew, as multiples of ``k``; the last round takes all that are left.
_ROUNDS = (4, 16, 64)
#: Exactly compared pairs held at once.
_PAIRS = 16_384

_CODED = "dim int, id bigint, vector array<double>, code binary, length double, fit double"
_FOUND = "query_id bigint, vec_id bigint, score double, compared bigint"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """The random orthogonal matrix of this dimension, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length after centring, and the inner product of unit vector and code."""
    dim = vectors.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        moved = vectors - centre
        length = np.sqrt((moved * moved).sum(axis=1))
        unit = moved / np.where(length > 0, length, 1)[:, None]
        turned = unit @ rotation(dim, seed).T
    fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(turned > 0, axis=1), length, fit


def least_distances(query: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray, seed: int, epsilon: float) -> np.ndarray:
    """The least squared distance of each query to each code, up to the error bound."""
    dim = query.shape[1]
    with np.errstate(all="ignore"):
        moved = (query - centre) @ rotation(dim, seed).T
        size = np.sqrt((moved * moved).sum(axis=1))[:, None]
        signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        product = (moved.astype(np.float32) @ signs.T).astype(np.float64) / fit
        width = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * epsilon / np.sqrt(max(dim - 1, 1)) * size + 1e-5 * size
        middle = length**2 + size**2 - 2 * length * product
        low = middle - 2 * length * width
    # A vector at the centre has no direction, and very large values overflow: such rows are always compared.
    return np.where(np.isfinite(low), low, -np.inf)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired columns, summed component by component."""
    total = np.zeros(left.shape[1])
    for a, b in zip(left, right):
        total += (a - b) ** 2
    return np.sqrt(total)


def rerank(low: np.ndarray, queries: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of all pairs compared exactly: ``low`` holds a row of least squared distances a query, infinite
    where a pair is not to be compared, ``columns`` the vectors component by component."""
    left, limit = low.copy(), np.full(len(low), np.inf)
    nearest = np.full((len(low), k), np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    for most in (*(k * r for r in _ROUNDS), None):
        open_ = (left < np.inf) & (left <= limit[:, None])
        if most is None or most >= left.shape[1]:
            q, v = np.nonzero(open_)
        else:
            first = np.argpartition(left, most - 1, axis=1)[:, :most]
            q, place = np.nonzero(np.take_along_axis(open_, first, axis=1))
            v = first[q, place]
        score = np.concatenate([exact(queries[q[p : p + _PAIRS]].T, columns[:, v[p : p + _PAIRS]]) for p in range(0, len(q), _PAIRS)] or [np.zeros(0)])
        found.append((q, v, score))
        left[q, v] = np.inf
        if most is None or not len(q) or most >= left.shape[1]:
            break
        seen = np.full((len(low), most), np.inf)
        seen[q, place] = score
        nearest = np.partition(np.concatenate([nearest, seen], axis=1), k - 1, axis=1)[:, :k]
        with np.errstate(over="ignore"):
            limit = nearest[:, k - 1] ** 2 * (1 + 1e-12)
    return tuple(np.concatenate(x) for x in zip(*found))


def _searcher(k: int, centres: dict[int, list[float]], seed: int, epsilon: float):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if vectors.num_rows and queries.num_rows:
            dim = vectors.column("dim")[0].as_py()
            centre = np.array(centres.get(dim, [0.0] * dim))
            rows, ids = matrix(vectors.column("vector").combine_chunks(), dim).T.copy(), vectors.column("id").to_numpy()
            codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            length, fit = vectors.column("length").to_numpy(), vectors.column("fit").to_numpy()
            asked, names = matrix(queries.column("vector").combine_chunks(), dim), queries.column("id").to_numpy()
            step = max(1, 4_000_000 // len(ids))
            for s in range(0, len(names), step):
                low = least_distances(asked[s : s + step], codes, length, fit, centre, seed, epsilon)
                low[names[s : s + step, None] == ids[None, :]] = np.inf
                q, v, score = rerank(low, asked[s : s + step], rows, k)
                compared = np.bincount(q, minlength=len(low))
                order = np.lexsort((ids[v], score, q))
                q, v, score = q[order], v[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                kept = rank < k
                # The number of comparisons stands in the first row of each query.
                found.append([names[s + q[kept]], ids[v[kept]], score[kept], np.where(rank == 0, compared[q], 0)[kept]])
        none = np.zeros(0, np.int64)
        parts = [np.concatenate(x) for x in zip(*found)] or [none, none, np.zeros(0), none]
        return pa.table(dict(zip(("query_id", "vec_id", "score", "compared"), parts)))

    return search


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dim) of the rows that take part: an id, and a vector that is not null, empty or zero and whose components are all finite."""
    good = (
        F.col("id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(good).withColumn("dim", F.size("vector"))


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, epsilon: float = EPSILON) -> DataFrame:
    """The ``k`` nearest vectors of each query: query_id, rank, vec_id, score (Euclidean distance), compared (vectors compared exactly for the query).

    Vectors and queries that are null, empty, zero or hold a null or non-finite component take no part, nor
    does a row without id. A query is not compared with rows of its own id, and only with vectors of its own
    length. Ties go to the smaller id. Rows that repeat an id and vector are all candidates, but one query. Fewer than ``k``
    candidates are all returned; empty tables give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["id", "vector"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(CENTRE_ROWS).select("dim", F.posexplode("vector").alias("place", "x"))
    centres: dict[int, list[float]] = {}
    for dim, place, x in sorted(sample.groupBy("dim", "place").agg(F.avg("x")).collect()):
        centres.setdefault(dim, []).append(x)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted(set(batch.column("dim").to_pylist())):
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                bits, length, fit = encode(matrix(part.column("vector"), dim), np.array(centres.get(dim, [0.0] * dim)), seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), part.column("id"), part.column("vector"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(fit)],
                    ["dim", "id", "vector", "code", "length", "fit"],
                )

    n, asks, cores = rows.count(), asked.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * cores, -(-n // 1_024)))
    lots = max(1, -(-asks // QUERY_ROWS))
    coded = rows.select("dim", "id", "vector").mapInArrow(index, _CODED)
    coded = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    keys = ["dim", "block", "lot"]
    found = coded.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(k, centres, seed, epsilon), _FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumns({"rank": F.row_number().over(best), "compared": F.sum("compared").over(Window.partitionBy("query_id"))})
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")
