"""Values that are computed once for each row, however often an expression names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def with_bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, below all filters and columns made of it.

    A plain column is written out again in every filter that Spark moves below it.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), F.explode(F.array(value)).alias(name))
