"""Vector retrieval and deterministic ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Candidate and ranking limits.
TOP_K = 5
CANDIDATE_MULTIPLIER = 3
SIMILAR_AMOUNT_FACTOR = 2.0
# Rows of one group of the block join, and of one distance matrix inside it.
QUERY_BATCH = 2048
BLOCK_ROWS = 32768
VECTOR_BLOCK = 2048
# Hyperplane tables: signature bits, tables, buckets that a query looks into per table. With these, neighbours
# of a cosine of 0.3 to 0.5 were found to 0.96 and more in a trial; nearer ones need fewer probes.
HASH_BITS, HASH_TABLES, HASH_PROBES = 10, 16, 48
MAX_HASH_BITS = 16


def _unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    matrix = flat.astype(np.float64).reshape(-1, dim)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine distances of paired rows, summed in component order: equal vectors have equal distances in every group."""
    total = np.zeros(len(left))
    for a, b in zip(left.T, right.T):
        total += a * b
    return 1.0 - total


def _first(k: int, groups: Sequence[np.ndarray], order: Sequence[np.ndarray]) -> np.ndarray:
    """Positions of the first k rows of each group in the order given."""
    at = np.lexsort([*reversed(order), *reversed(groups)])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for group in groups:
        new[1:] |= group[at][1:] != group[at][:-1]
    starts = np.flatnonzero(new)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[rank < k]


def _scan(k: int, per: str | None, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Compare one block of vectors with one batch of queries; keep the k best per query (and label)."""

    def scan(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not part.num_rows or not asked.num_rows:
            return schema.empty_table()
        dim = part.column("dim")[0].as_py()
        units, wanted = _unit(part.column("vector"), dim), _unit(asked.column("vector"), dim)
        ids = pc.rank(part.column("document_id").combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
        labels = np.zeros(part.num_rows, np.int64)
        if per:
            labels = pc.rank(part.column(per).combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
        by_label = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[by_label])) + 1
        q, v, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for rows in np.split(by_label, edges):
            for at in range(0, len(rows), VECTOR_BLOCK):
                these = rows[at:at + VECTOR_BLOCK]
                rough = 1.0 - wanted @ units[these].T
                near = np.ones(rough.shape, bool)
                if len(these) > k:
                    # The margin is above the rounding of the product; the paired sums decide.
                    near = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1:k] + 1e-9
                rows_q, cols = np.nonzero(near)
                for pair in range(0, len(rows_q), QUERY_BATCH * 64):
                    new_q, new_v = rows_q[pair:pair + QUERY_BATCH * 64], these[cols[pair:pair + QUERY_BATCH * 64]]
                    q, v = np.append(q, new_q), np.append(v, new_v)
                    distance = np.append(distance, _distances(wanted[new_q], units[new_v]))
                    kept = _first(k, [q, labels[v]], [distance, ids[v]])
                    q, v, distance = q[kept], v[kept], distance[kept]
        columns = [asked.column("query_id").take(pa.array(q)), part.column("document_id").take(pa.array(v)), pa.array(distance)]
        if per:
            columns.append(part.column(per).take(pa.array(v)))
        return pa.table(columns, names=schema.names)

    return scan


def _usable(df: DataFrame, *names: str) -> DataFrame:
    """Rows with a vector of finite components, and its length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(*names, "vector").where(finite & (F.size("vector") > 0)).withColumn("dim", F.size("vector"))


def _found_type(queries: DataFrame, vectors: DataFrame, per: str | None) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType),
              T.StructField("document_id", vectors.schema["document_id"].dataType), T.StructField("distance", T.DoubleType())]
    return T.StructType([*fields, *([vectors.schema[per]] if per else [])])


def _compare(vectors: DataFrame, queries: DataFrame, keys: Sequence[str], k: int, per: str | None, fields: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    pairs = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys))
    return pairs.applyInArrow(_scan(k, per, to_arrow_schema(fields)), fields)


def nearest_neighbors(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, per: str | None = None, batch: int = QUERY_BATCH,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k by cosine distance, lower is closer; ties go to the smaller id.

    ``queries`` has query_id and vector, ``vectors`` document_id and vector (and
    the ``per`` column for a top-k inside each label); ids are unique. Both sides
    are dealt into blocks by hash; each block of vectors meets each batch of
    queries in one group of bounded size, which returns k rows per query. So the
    vectors are shuffled once per batch of queries and neither table passes the
    driver. Vectors that are null, empty or hold a null or non-finite component
    take no part, zero vectors are at distance 1, and only vectors of the same
    length are compared.
    """
    fields = _found_type(queries, vectors, per)
    rows, asked = _usable(vectors, "document_id", *([per] if per else [])), _usable(queries, "query_id")
    blocks = max(1, -(-rows.count() // block))
    batches = max(1, -(-asked.count() // batch))

    def dealt(df: DataFrame, own: str, mine: int, other: str, theirs: int) -> DataFrame:
        numbered = df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(mine)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))

    found = _compare(dealt(rows, "_block", blocks, "_batch", batches), dealt(asked, "_batch", batches, "_block", blocks),
                     ["dim", "_block", "_batch"], k, per, fields)
    order = Window.partitionBy("query_id", *([per] if per else [])).orderBy("distance", "document_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@lru_cache(maxsize=8)
def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _bucketed(tables: int, bits: int, probes: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row once per table and probe: its own bucket, then those whose differing bits it is least sure of."""
    masks = np.arange(1 << bits)
    powers = 1 << np.arange(bits)
    flips = ((masks[:, None] & powers) > 0).astype(np.float64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = whole.filter(pa.array(dims == dim))
                # A slice bounds the copies that stand at once.
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    unit = _unit(pa.chunked_array([some.column("vector")]), int(dim))
                    side = (unit @ _planes(int(dim), tables, bits, seed)).reshape(-1, tables, bits)
                    own = (side > 0) @ powers
                    mask = np.zeros((*own.shape, 1), np.int64)
                    if probes > 1:
                        mask = np.argsort((side * side) @ flips.T, axis=2, kind="stable")[:, :, :probes]
                    bucket = (own[:, :, None] ^ mask).astype(np.int32)
                    copies = tables * bucket.shape[2]
                    out = some.take(pa.array(np.repeat(np.arange(some.num_rows), copies)))
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), bucket.shape[2]), some.num_rows)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(table), pa.array(bucket.ravel())],
                                                     names=[*some.schema.names, "_table", "_bucket"])

    return code


def hashed_neighbors(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, per: str | None = None, bits: int = HASH_BITS,
    tables: int = HASH_TABLES, probes: int = HASH_PROBES, seed: int = 7, batch: int = QUERY_BATCH, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k by cosine distance among vectors that share a bucket of a hyperplane table with the query.

    Like ``nearest_neighbors``, but a query is compared with a part of the vectors
    only: each table signs a vector by ``bits`` random hyperplanes, and a query
    looks into its own bucket and the ``probes - 1`` buckets nearest to it. Found
    vectors are compared exactly, so distances are right and a neighbour can only
    be missing. Buckets are cut into parts and batches of bounded size by their
    counts. Every vector is shuffled once per table, whatever the number of
    queries; below some ``tables * batch`` queries the exact form moves less.
    """
    if not 1 <= bits <= MAX_HASH_BITS or tables < 1 or probes < 1:
        raise ValueError(f"bits must be from 1 to {MAX_HASH_BITS}, tables and probes at least 1")
    fields = _found_type(queries, vectors, per)

    def coded(df: DataFrame, probed: int) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("_table", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
        return df.mapInArrow(_bucketed(tables, bits, probed, seed), schema)

    rows = coded(_usable(vectors, "document_id", *([per] if per else [])), 1)
    asked = coded(_usable(queries, "query_id"), min(probes, 1 << bits))
    keys = ["dim", "_table", "_bucket"]

    def counted(df: DataFrame, name: str, most: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))

    # One row per bucket: at most tables * 2^bits per vector length, so it may be broadcast.
    sizes = counted(rows, "_parts", block).join(counted(asked, "_batches", batch), keys)

    def dealt(df: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        numbered = df.join(F.broadcast(sizes), keys).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop(mine, theirs)

    found = _compare(dealt(rows, "_part", "_parts", "_batch", "_batches"), dealt(asked, "_batch", "_batches", "_part", "_parts"),
                     [*keys, "_part", "_batch"], k, per, fields)
    group = ["query_id", *([per] if per else [])]
    # A vector found in several buckets has the same distance in each.
    order = Window.partitionBy(*group).orderBy("distance", "document_id")
    best = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.dropDuplicates([*group, "document_id"])


def first_non_empty(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def deduplicate(df: DataFrame, group: Sequence[str], keys: Sequence[str], rank: str) -> DataFrame:
    """One row per identity: the first non-empty key; the smallest input rank wins."""
    identity = first_non_empty(*keys, *(["document_id"] if "document_id" in df.columns else []))
    marked = df.withColumn("_identity", F.coalesce(identity, F.to_json(F.struct(*df.columns))))
    kept = [c for c in df.columns if c not in group]
    first = marked.groupBy(*group, "_identity").agg(F.min_by(F.struct(*kept), F.col(rank)).alias("_row"))
    return first.select(*group, "_row.*").select(*df.columns)


def finite_distance(name: str = "distance") -> Column:
    value = F.col(name).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(value)


def knowledge_priority(metadata: str = "metadata") -> Column:
    """0 current primary text of the regulator, 1 current, 2 secondary or reference, 3 historical."""
    status, kind, authority = (F.lower(F.coalesce(F.col(f"{metadata}.{n}"), F.lit("")))
                               for n in ("status", "source_type", "authority"))
    current = (status == "current") & F.coalesce(F.col(f"{metadata}.current_authority"), F.lit(False))
    return (F.when(current & (authority == "rbi") & (kind == "primary_regulatory"), 0).when(current, 1)
            .when(kind == "secondary_analysis", 2)
            .when((status == "historical") | (kind == "historical_reference"), 3).otherwise(2))


def _top(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None, name: str) -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def rank_knowledge(df: DataFrame, group: Sequence[str] = ("query_id",), k: int | None = TOP_K,
                   input_rank: str = "rank") -> DataFrame:
    unique = deduplicate(df, group, ["document_id"], input_rank).withColumn("metadata_priority", knowledge_priority())
    order = [F.col("metadata_priority"), finite_distance(), F.coalesce(F.col("document_id").cast("string"), F.lit(""))]
    return _top(unique, group, order, k, "knowledge_rank")


def _finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def _sign(value: Column) -> Column:
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def rank_cases(df: DataFrame, group: Sequence[str] = ("alert_id",), k: int | None = TOP_K,
               input_rank: str = "rank") -> DataFrame:
    """Cases by type, amount range, balance behaviour, distance and id.

    Each row holds a candidate (document_id, source_row_id, distance, metadata)
    and the fields of its alert (transaction_type, amount, balances).
    """
    unique = deduplicate(df, group, ["source_row_id"], input_rank)
    alert_type = F.upper(F.coalesce(F.col("transaction_type"), F.lit("")))
    same_type = (alert_type != "") & (F.upper(F.coalesce(F.col("metadata.transaction_type"), F.lit(""))) == alert_type)
    mine, theirs = _finite(F.col("amount")), _finite(F.col("metadata.amount"))
    larger, smaller = F.greatest(mine, theirs), F.least(mine, theirs)
    amount_ratio = F.when(mine.isNotNull() & theirs.isNotNull(), F.when(
        larger > 0, larger / F.greatest(smaller, F.lit(1e-12))).otherwise(1.0))
    old_o, new_o = _finite(F.col("old_balance_orig")), _finite(F.col("new_balance_orig"))
    old_d, new_d = _finite(F.col("old_balance_dest")), _finite(F.col("new_balance_dest"))
    case_delta = _finite(F.col("metadata.balance_change_amount"))
    compared = [
        F.col("metadata.origin_balance_depleted") == ((old_o > 0) & (new_o == 0)),
        F.col("metadata.origin_balance_unchanged") == (old_o == new_o),
        F.col("metadata.destination_balance_increased") == (new_d > old_d),
        F.col("metadata.destination_balance_unchanged") == (new_d == old_d),
        F.when(case_delta.isNotNull() & old_o.isNotNull() & new_o.isNotNull(),
               _sign(case_delta) == _sign(new_o - old_o)),
    ]
    known = F.array_compact(F.array(*[c.cast("int") for c in compared]))
    count = F.size(known)
    score = F.when(count > 0, F.aggregate(known, F.lit(0), lambda a, x: a + x) / count)
    reasons = unique.withColumns({
        "same_transaction_type": same_type, "amount_ratio": amount_ratio,
        "similar_amount_range": F.coalesce(amount_ratio <= SIMILAR_AMOUNT_FACTOR, F.lit(False)),
        "balance_match_score": score, "balance_comparisons": count,
    })
    order = [F.col("same_transaction_type").desc(), F.col("similar_amount_range").desc(),
             F.coalesce(F.col("balance_match_score"), F.lit(0.0)).desc(), finite_distance(),
             F.coalesce(F.col("source_row_id").cast("string"), F.lit(""))]
    return _top(reasons, group, order, k, "case_rank")


def rank_recent(df: DataFrame, group: Sequence[str], keys: Sequence[str], limit: int, input_rank: str,
                times: Sequence[str] = ("event_time", "generated_at")) -> DataFrame:
    """Newest distinct records; times compare as text, ties keep the input order."""
    unique = deduplicate(df, group, keys, input_rank)
    have = [t for t in times if t in df.columns]
    text = F.coalesce(*[F.col(t).cast("string") for t in have], F.lit(""))
    return _top(unique, group, [text.desc(), F.col(input_rank)], limit, "recent_rank")
