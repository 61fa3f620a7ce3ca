"""Text expressions shared by case documents, queries and checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DIGITS = 10


def present(value: Column) -> Column:
    """The value as text, or null when it is null or empty."""
    return F.nullif(value.cast("string"), F.lit(""))


def as_decimal(value: Column) -> Column:
    """Exact base-10 value of a text amount; anything not finite gives null."""
    return value.try_cast(f"decimal(38,{_DIGITS})")


def _scale(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(".")), F.length(F.substring_index(value, ".", -1))).otherwise(0)


def decimal_difference(new: Column, old: Column) -> Column:
    """``new - old`` as plain decimal text with the longer scale of the two inputs."""
    exact = (as_decimal(new) - as_decimal(old)).cast(f"decimal(38,{_DIGITS})").cast("string")
    scale = F.least(F.greatest(_scale(new.cast("string")), _scale(old.cast("string"))), F.lit(_DIGITS))
    dropped = F.when(scale == 0, F.lit(_DIGITS + 1)).otherwise(F.lit(_DIGITS) - scale)
    return F.substring(exact, F.lit(1), F.length(exact) - dropped)


def labelled(label: str, value: Column) -> Column:
    """``label value`` when the value is there, else null (skipped by concat_ws)."""
    return F.concat(F.lit(f"{label} "), present(value))
