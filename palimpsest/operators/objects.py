"""Namespaces: paths that name objects of registered models, and what each model's objects consist of.

A reference is 46 bytes: model, format (16 bits), flags, depth (8 bits), size
(64 bits), all little-endian, and a root of 32 bytes. A registry has a row
(model, name, walkable, accumulates) for each model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codec import little_endian
from palimpsest.functions.grammar import valid_path
from palimpsest.operators.diff import diff

REFERENCE = {"model": 2, "format": 2, "flags": 1, "depth": 1, "size": 8}
FIELDS = [*REFERENCE, "root"]


def encode_reference(model: Column, format_: Column, flags: Column, depth: Column, size: Column, root: Column) -> Column:
    """The bytes of a reference; ``root`` is 64 hexadecimal digits."""
    parts = [little_endian(c.cast("long"), w) for c, w in zip((model, format_, flags, depth, size), REFERENCE.values(), strict=True)]
    return F.concat(*parts, F.unhex(root))


def decode_reference(data: Column) -> Column:
    """The struct of a reference; null if it has not 46 bytes."""
    digits, place, fields = F.hex(data), 1, []
    for name, width in REFERENCE.items():
        turned = F.concat(*(F.substring(digits, place + 2 * k, 2) for k in range(width - 1, -1, -1)))
        fields.append(F.conv(turned, 16, 10).cast("long").alias(name))
        place += 2 * width
    return F.when(F.octet_length(data) == 46, F.struct(*fields, F.lower(F.substring(digits, place, 64)).alias("root")))


def refusals(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries (path and a reference's fields) that a namespace refuses, with the reason: path, flags or model."""
    known = F.broadcast(registry.select("model", F.lit(True).alias("known")))  # a registry has at most 65,536 models
    reason = F.when(~valid_path(F.col("path")), "path").when(F.col("flags") != 0, "flags").when(F.col("known").isNull(), "model")
    return entries.join(known, "model", "left").withColumn("reason", reason).where("reason is not null").select("path", "model", "flags", "reason")


def lookup(namespace: DataFrame, registry: DataFrame, paths: DataFrame) -> DataFrame:
    """For each wanted path, whether it is there, and its reference with the model's name; of an unknown model nothing but that."""
    found = paths.join(namespace.select("path", decode_reference(F.col("ref")).alias("r"), F.lit(True).alias("there")), "path", "left")
    named = found.join(F.broadcast(registry.select(F.col("model").alias("m"), "name")), F.col("r.model") == F.col("m"), "left")
    state = F.when(~valid_path(F.col("path")), "invalid").when(F.col("there").isNull(), "absent").when(F.col("name").isNull(), "unknown model").otherwise("ok")
    fields = [F.when(F.col("state") == "ok", F.col(f"r.{c}")).alias(c) for c in FIELDS]
    return named.withColumn("state", state).select("path", "state", "name", *fields)


def namespace_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of namespaces (path, ref), with decoded references; an invalid path on either side is an error."""
    checked = lambda df: df.select(F.when(valid_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("invalid path "), "path")).cast("string")).alias("path"), decode_reference(F.col("ref")).alias("r")).select("path", "r.*")
    return diff(checked(before), checked(after), "path", FIELDS)


def open_faults(claims: DataFrame, found: DataFrame, format_: int) -> DataFrame:
    """Objects (object, format, depth, size) that can't be opened, with the reason: another format, a depth, or another size than ``found`` has (object, n)."""
    n = F.coalesce("n", F.lit(0).cast("long"))
    reason = F.when(F.col("format") != format_, "format").when(F.col("depth") != 0, "depth").when(n != F.col("size"), "size")
    return claims.join(found, "object", "left").select("object", "size", n.alias("n"), reason.alias("reason")).where("reason is not null")


def long_values(values: DataFrame, pieces: DataFrame, limit: int) -> DataFrame:
    """key, value, refused of values (key, inline, stream, size): inline bytes, or the stream's pieces (stream, seq, data) in order.

    Values over ``limit`` bytes are refused, and their pieces not read.
    """
    sized = values.withColumn("size", F.coalesce(F.octet_length("inline").cast("long"), "size")).withColumn("refused", F.coalesce(F.col("size") > limit, F.lit(False)))
    wanted = sized.where("inline is null and not refused").select("stream").distinct()
    joined = pieces.join(wanted, "stream", "left_semi").groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]), "").alias("read"))  # at most ``limit`` bytes
    value = F.when(~F.col("refused"), F.coalesce("inline", "read"))
    return sized.join(joined, "stream", "left").select("key", value.alias("value"), "refused")


def walk(objects: DataFrame, entries: DataFrame, registry: DataFrame) -> DataFrame:
    """object and root of everything that objects (object, model, root) consist of: their own root, and those of a tree's entries (object, root).

    An object whose model is unknown or not walkable refuses the whole walk.
    """
    known = F.broadcast(registry.where("walkable").select("model", "name"))
    if (strange := objects.join(known, "model", "left_anti").limit(1).collect()) != []:
        raise ValueError(f"model {strange[0]['model']} can't be walked: nothing is decided")
    own = objects.join(known, "model")
    inner = entries.join(own.where("name = 'tree'").select("object"), "object", "left_semi").select("object", "root")
    return own.select("object", "root").unionByName(inner).distinct()


def duplicate_models(registry: DataFrame) -> DataFrame:
    """Models that several names claim, which a registry refuses."""
    return registry.select("model", "name").distinct().groupBy("model").agg(F.count("*").alias("names")).where("names > 1")
