"""Which names are valid, as boolean columns; null is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x1f\x7f]"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_path(path: Column) -> Column:
    """1 to 64 segments of 1 to 255 bytes between slashes, none . or .., no control character, at most 4096 bytes."""
    segments = F.split(path, "/", -1)
    ok = F.forall(segments, lambda s: F.octet_length(s).between(1, 255) & ~s.isin(".", ".."))
    return _sure(ok & (F.size(segments) <= 64) & (F.octet_length(path) <= 4096) & ~path.rlike(CONTROL))


def valid_ref(name: Column) -> Column:
    """Branches and tags: letters, digits and ._/- after a letter or digit, at most 128, no .., //, final / or .lock."""
    return _sure(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,127}\z") & ~name.rlike(r"\.\.|//|/\z|\.lock\z"))


def valid_object_name(name: Column) -> Column:
    """At most 8 segments of 1 to 128 of [a-z0-9._-], none beginning with a dot, at most 512 characters."""
    return _sure(name.rlike(r"^[a-z0-9_-][a-z0-9._-]{0,127}(/[a-z0-9_-][a-z0-9._-]{0,127}){0,7}\z") & (F.octet_length(name) <= 512))


def valid_principal(name: Column) -> Column:
    """1 to 256 bytes without control characters."""
    return _sure(F.octet_length(name).between(1, 256) & ~name.rlike(CONTROL))
