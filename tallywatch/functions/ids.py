"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace, as lower-case text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    dash = F.lit("-")
    return F.lower(F.concat(
        F.substring(digest, 1, 8), dash, F.substring(digest, 9, 4), dash, F.lit("5"), F.substring(digest, 14, 3), dash,
        F.hex(variant.cast("long")), F.substring(digest, 18, 3), dash, F.substring(digest, 21, 12)))


def _present(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def alert_id(supplied: Column | None, transaction_id: Column, fields: Sequence[str] = ()) -> Column:
    """The supplied id, else one derived from the transaction, else from all fields.

    The last form hashes a canonical JSON text of the named fields.
    """
    choices = [] if supplied is None else [_present(supplied)]
    choices.append(uuid5_url(F.concat(F.lit("fraud-alert:"), _present(transaction_id))))
    if fields:
        canonical = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(fields)]))
        choices.append(F.concat(F.lit("alert_"), F.sha2(canonical, 256)))
    return F.coalesce(*choices)


def content_id(kind: str, *parts: Column) -> Column:
    """``<kind>_<sha256 of the joined parts>``."""
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat(*[p.cast("string") for p in parts]), 256))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded pseudo-random order in [0, 2**52), the same in every engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
