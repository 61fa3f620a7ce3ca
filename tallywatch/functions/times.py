"""Event time parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywatch.functions.bound import bound

_ISO = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?"
        r"(Z|[+-]\d{2}(:?\d{2})?)?)?$")


def parse_event_time(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; blank or invalid text gives null.

    A text without an offset is read as UTC, which is the session time zone.
    """
    def read(trimmed: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(trimmed, " ", "T"), ",", ".")
        offset = bound(F.regexp_replace(spaced, r"([+-]\d{2})(\d{2})$", "$1:$2"),
                       lambda t: F.when(t.rlike(r"T.*[+-]\d{2}$"), F.concat(t, F.lit(":00"))).otherwise(t))
        full = bound(offset, lambda t: F.when(t.rlike(r"T\d{2}(Z|[+-].*)?$"), F.regexp_replace(t, r"T(\d{2})", "T$1:00")).otherwise(t))
        return F.when(trimmed.rlike(_ISO), F.try_to_timestamp(full))

    return bound(F.trim(text), read)
