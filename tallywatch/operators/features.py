"""Row-local features: balance movements, flags, encodings, finite checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.schema import TRANSACTION_TYPES


def balance_features(df: DataFrame) -> DataFrame:
    """Balance movement of both ends and what the amount does not explain."""
    origin = F.col("oldbalanceOrg") - F.col("newbalanceOrig")
    target = F.col("newbalanceDest") - F.col("oldbalanceDest")
    return df.withColumns({
        "orig_balance_change": origin,
        "dest_balance_change": target,
        "orig_balance_error": F.col("amount") - origin,
        "dest_balance_error": F.col("amount") - target,
    })


def zero_flags(df: DataFrame) -> DataFrame:
    def zero(name: str) -> Column:
        return F.when(F.col(name) == 0.0, 1.0).otherwise(0.0)

    return df.withColumns({
        "orig_zero_after": zero("newbalanceOrig"),
        "dest_zero_before": zero("oldbalanceDest"),
        "dest_zero_after": zero("newbalanceDest"),
    })


def log_amount(df: DataFrame, clip: bool = False) -> DataFrame:
    """log1p of the amount; ``clip`` first lifts negative amounts to 0."""
    amount = F.greatest(F.col("amount"), F.lit(0.0)) if clip else F.col("amount")
    return df.withColumn("log_amount", F.log1p(amount))


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    prefix = column if prefix is None else prefix
    return df.withColumns({
        f"{prefix}_{value}": F.when(F.col(column) == value, 1.0).otherwise(0.0) for value in categories
    })


def discovered_categories(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """Sorted distinct values of a low-cardinality column; refuses a wide one."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(row[0] for row in rows)


def base_features(df: DataFrame) -> DataFrame:
    """The derived half of the 19 base features, all in one projection."""
    return one_hot(log_amount(zero_flags(balance_features(df))), "type", TRANSACTION_TYPES, "type")


def non_finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass: nulls, NaNs and infinities per column, as a long table."""
    counts = []
    for name in columns:
        value = F.col(name).cast("double")
        counts += [
            F.count_if(value.isNull()).alias(f"{name}__null"),
            F.count_if(F.isnan(value)).alias(f"{name}__nan"),
            F.count_if(F.abs(value) == float("inf")).alias(f"{name}__inf"),
        ]
    entries = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"{name}__null").alias("null_count"),
                 F.col(f"{name}__nan").alias("nan_count"), F.col(f"{name}__inf").alias("inf_count"))
        for name in columns
    ])
    return df.agg(*counts).select(F.inline(entries))


def reject_non_finite(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(finite rows, rejected rows naming the offending columns)."""
    marked = df.withColumn(
        "violations", F.array_compact(F.array(*[F.when(non_finite(c), F.lit(c)) for c in columns])))
    clean = F.size("violations") == 0
    return marked.where(clean).drop("violations"), marked.where(~clean)


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job on the first non-finite value instead of rejecting rows."""
    bad = F.array_compact(F.array(*[F.when(non_finite(c), F.lit(c)) for c in columns]))
    message = F.concat(F.lit("non-finite feature values: "), F.concat_ws(", ", bad))
    return df.where(F.when(F.size(bad) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
