"""Table profiling as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from tallywatch.operators.evaluate import long_form
from tallywatch.operators.ordered import exact_quantiles


def column_audit(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing count and share, distinct values; mean, std, min and max for numbers."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = [(name, kind) for name, kind in df.dtypes]

    def is_number(kind: str) -> bool:
        return kind in numeric or kind.startswith("decimal")

    parts = [F.count(F.lit(1)).alias("_rows")]
    for name, kind in kinds:
        parts.append(F.count(F.col(name)).alias(f"{name}__n"))
        if is_number(kind):
            value = F.col(name).cast("double")
            parts += [F.avg(value).alias(f"{name}__mean"), F.stddev(value).alias(f"{name}__std"),
                      F.min(value).alias(f"{name}__min"), F.max(value).alias(f"{name}__max")]
        if approximate:
            parts.append(F.approx_count_distinct(name).alias(f"{name}__d"))

    def stat(name: str, kind: str, which: str):
        return (F.col(f"{name}__{which}") if is_number(kind) else F.lit(None).cast("double")).alias(which)

    rows = df.agg(*parts).select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("column_name"), F.lit(kind).alias("type"),
            (F.col("_rows") - F.col(f"{name}__n")).alias("missing"),
            F.when(F.col("_rows") > 0, (F.col("_rows") - F.col(f"{name}__n")) * 100.0 / F.col("_rows"))
            .otherwise(0.0).alias("missing_pct"),
            (F.col(f"{name}__d") if approximate else F.lit(0).cast("long")).alias("distinct_values"),
            *[stat(name, kind, which) for which in ("mean", "std", "min", "max")])
        for name, kind in kinds])))
    if approximate:
        return rows
    # Equal values merge before the shuffle, so a frequent value costs nothing.
    texts = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("v")) for n, _ in kinds])
    distinct = (df.select(F.inline(texts)).where("v IS NOT NULL").groupBy("column_name", "v").agg(F.lit(1).alias("o"))
                .groupBy("column_name").agg(F.count("*").alias("distinct_values")))
    return rows.drop("distinct_values").join(distinct, "column_name", "left").fillna(0, ["distinct_values"])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier identical row."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, sample std and variance, min, median, max per column."""
    values = long_form(df, columns)
    medians = exact_quantiles(values, "value", [0.5], ["feature"]).select(
        "feature", F.col("quantile").alias("median"))
    stats = values.groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.variance("value").alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(medians, "feature", "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, from one aggregate, in long form."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("correlation"))
               for i, pair in enumerate(pairs) for a, b in (pair, pair[::-1])]
    entries += [F.struct(F.lit(c).alias("left"), F.lit(c).alias("right"), F.lit(1.0).alias("correlation"))
                for c in columns]
    return row.select(F.inline(F.array(*entries)))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def active_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Active rows and their share for each 0/1 column, one pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f) == 1).alias(f) for f in flags])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("active_rows"),
                 (F.col(f) * 100.0 / F.greatest(F.col("_rows"), F.lit(1))).alias("pct")) for f in flags])))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    positives = F.count_if(F.col(label) == 1)
    return df.agg(
        F.count("*").alias("rows"), positives.alias("positives"),
        (positives * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("positive_pct"),
        (F.count_if(F.col(label) == 0) / F.greatest(positives, F.lit(1))).alias("imbalance_ratio"))
