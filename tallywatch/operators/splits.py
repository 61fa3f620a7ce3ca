"""Splits and samples that never sort a whole table in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.ids import hash_order
from tallywatch.operators.ordered import leading_rows, rank_values, ranked_values


def rows_at_ranks(df: DataFrame, order: Sequence[str], ranks: Sequence[int]) -> dict[int, tuple]:
    """Order values of the rows at the given 0-based ranks of a total order.

    Works column by column: find the value that spans each rank, keep its rows
    only, go on with the next column. Only the found values reach the driver.
    """
    found: dict[int, tuple[tuple, int]] = {rank: ((), rank) for rank in ranks}
    for depth, column in enumerate(order):
        groups = list(order[:depth])
        scope = df
        if depth:
            match = F.lit(False)
            for prefix in {prefix for prefix, _ in found.values()}:
                same = F.lit(True)
                for name, value in zip(groups, prefix):
                    same = same & (F.col(name) == F.lit(value))
                match = match | same
            scope = df.where(match)
        ranked = ranked_values(scope.select(*order[:depth + 1]), column, groups)
        hit = F.lit(False)
        for prefix, rest in found.values():
            same = (F.col("n_before") <= rest) & (F.lit(rest) < F.col("n_before") + F.col("n"))
            for name, value in zip(groups, prefix):
                same = same & (F.col(name) == F.lit(value))
            hit = hit | same
        rows = ranked.where(hit).select(*groups, column, "n_before", "n").collect()
        for rank, (prefix, rest) in list(found.items()):
            for row in rows:
                if tuple(row[g] for g in groups) == prefix and row["n_before"] <= rest < row["n_before"] + row["n"]:
                    found[rank] = (prefix + (row[column],), rest - row["n_before"])
    return {rank: prefix for rank, (prefix, _) in found.items()}


def chronological_label(
    df: DataFrame, order: Sequence[str] = ("step", "amount", "event_id"),
    shares: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "validation", "test"),
) -> Column:
    """The split of a row by its position in a total order: first 60 %, next 20 %, rest.

    The cut rows are found by selection over the order columns of ``df``. The
    result is a plain expression over those columns, so it can label any frame
    built from the same rows, and labelling shuffles nothing.
    """
    total = df.count()
    ends, used = [], 0.0
    for share in shares[:-1]:
        used += share
        ends.append(math.floor(round(used, 9) * total))
    inner = sorted({end for end in ends if 0 < end < total})
    cuts = rows_at_ranks(df, order, inner) if inner else {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    here = F.struct(*[F.col(c) for c in order])

    def before(end: int) -> Column:
        if end <= 0:
            return F.lit(False)
        if end >= total:
            return F.lit(True)
        return here < F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cuts[end])])

    label = F
    for end, name in zip(ends, names):
        label = label.when(before(end), F.lit(name))
    return label.otherwise(F.lit(names[-1]))


def chronological_split(
    df: DataFrame, order: Sequence[str] = ("step", "amount", "event_id"),
    shares: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "validation", "test"),
) -> DataFrame:
    return df.withColumn("split", chronological_label(df, order, shares, names))


def stratified_split(
    df: DataFrame, label: str, key: str, shares: Sequence[float] = (0.6, 0.2, 0.2),
    names: Sequence[str] = ("train", "validation", "test"), seed: int = 42,
) -> DataFrame:
    """Seeded random split with the same shares in every class.

    Rows follow a seeded hash; the hash value at each cut is found per class and
    a comparison with it labels the row.
    """
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    ends, used = [], 0.0
    for share in shares[:-1]:
        used += share
        ends.append(round(used, 9))
    # One value per class and cut: the classes are few, so the cuts become literals.
    cuts = rank_values(hashed, "_hash", ends, [label], interpolate=False).collect()
    split = F
    for end, name in zip(ends, names):
        below = F.lit(False)
        for row in cuts:
            if row["share"] == end:
                below = below | (F.col(label).eqNullSafe(F.lit(row[label])) & (F.col("_hash") < F.lit(row["quantile"])))
        split = split.when(below, F.lit(name))
    return hashed.withColumn("split", split.otherwise(F.lit(names[-1]))).drop("_hash")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, the same rows for the same seed, in no particular order.

    Rows whose keys have the same hash at the edge are taken by key; rows that share a key are alike to it.
    """
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    return leading_rows(hashed, "_hash", k, tie=key).drop("_hash")


def expected_sizes(total: int, shares: Sequence[float]) -> list[int]:
    """Row counts the chronological split gives, for checks."""
    ends, used = [0], 0.0
    for share in shares[:-1]:
        used += share
        ends.append(math.floor(round(used, 9) * total))
    ends.append(total)
    return [b - a for a, b in zip(ends, ends[1:])]
