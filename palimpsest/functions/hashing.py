"""Content hashes: 64 lowercase hexadecimal digits, ordered as their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    """SHA-256 of the exact bytes."""
    return F.sha2(data, 256)


def canonical(*columns: Column) -> Column:
    """An injective text of any values: each field's length in bytes, a colon and the field; a null is an n."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    return F.concat(*map(field, columns))


def row_hash(*columns: Column) -> Column:
    return content_hash(canonical(*columns))


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def short(hash_: Column) -> Column:
    """The first twelve digits, as shown to people."""
    return F.substring(hash_, 1, 12)


def window(hash_: Column, level: int) -> Column:
    """The four-byte window of a hash that decides at ``level`` of a tree; from level 8 on the hash is hashed anew."""
    if level >= 8:
        hash_ = content_hash(F.concat(F.unhex(hash_), F.unhex(F.lit(f"{level // 8:02x}"))))
    return F.conv(F.substring(hash_, 1 + 8 * (level % 8), 8), 16, 10).cast("long")
