"""Byte encodings that hashes depend on: little-endian integers, minimal varints, lengths before bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(value: Column, width: int) -> Column:
    """A non-negative BIGINT as ``width`` bytes."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 1 + 2 * k, 2) for k in range(width - 1, -1, -1))))


def uvarint(value: Column) -> Column:
    """A non-negative BIGINT in base 128, low digits first, in as few bytes as it takes."""
    parts = []
    for k in range(9):
        digit = F.shiftright(value, 7 * k).bitwiseAND(F.lit(127))
        more = F.shiftright(value, 7 * (k + 1)) > 0
        byte = F.lpad(F.hex(digit + F.when(more, 128).otherwise(0)), 2, "0")
        parts.append(F.when((F.shiftright(value, 7 * k) > 0) | F.lit(k == 0), byte).otherwise(""))
    return F.unhex(F.concat(*parts))


def uvarint_size(value: Column) -> Column:
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(F.shiftright(value, 7 * k) > 0, 1).otherwise(0)
    return size


def sized(data: Column) -> Column:
    """Bytes with their length before them."""
    return F.concat(uvarint(F.octet_length(data).cast("long")), data)


def entry_size(key: Column, value: Column) -> Column:
    """Encoded bytes of a map entry: both lengths, a tag and both strings."""
    size = lambda c: uvarint_size(F.octet_length(c).cast("long")) + F.octet_length(c)
    return size(key) + size(value) + 1
