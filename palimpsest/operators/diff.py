"""Differences of two keyed snapshots.

The comparison joins keys and row hashes alone, so wide rows are not shuffled
for it; a shared part of two snapshots can be pruned by segment hashes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import row_hash

ADDED, REMOVED, MODIFIED = 1, 2, 3


def diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """kind, key and from_ and to_ values of every key whose row is not the same on both sides.

    Keys are unique and not null on each side, as in every stored snapshot: a
    null key would be removed and added, and a repeated one multiply.
    """
    a = before.select(F.col(key).alias("key"), F.lit(True).alias("in_a"), *(F.col(v).alias(f"from_{v}") for v in values))
    b = after.select(F.col(key).alias("key"), F.lit(True).alias("in_b"), *(F.col(v).alias(f"to_{v}") for v in values))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"from_{v}").eqNullSafe(F.col(f"to_{v}"))
    kind = F.when(F.col("in_a").isNull(), ADDED).when(F.col("in_b").isNull(), REMOVED).when(~same, MODIFIED)
    joined = a.join(b, "key", "full_outer").withColumn("kind", kind).where("kind is not null")
    return joined.select("kind", "key", *(f"{side}_{v}" for v in values for side in ("from", "to")))


def diff_by_hash(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """kind and key only, from a join of keys and row hashes: for wide rows, fetched afterwards by key."""
    side = lambda df, name: df.select(F.col(key).alias("key"), row_hash(*(F.col(v) for v in values)).alias(name))
    joined = side(before, "ha").join(side(after, "hb"), "key", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
    return joined.select(F.when(F.col("ha").isNull(), ADDED).when(F.col("hb").isNull(), REMOVED).otherwise(MODIFIED).alias("kind"), "key")


def segment_hashes(snapshot: DataFrame, key: str, values: list[str], width: int) -> DataFrame:
    """segment, digest and rows of key ranges of ``width``: order-free sums of row hashes, combined map-side."""
    rows = snapshot.select(F.floor(F.col(key) / width).alias("segment"), F.xxhash64(key, *values).alias("h"))
    parts = lambda c, shift: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.groupBy("segment").agg(F.sum(parts(F.col("h"), 0)).alias("low"), F.sum(parts(F.col("h"), 32)).alias("high"), F.count("*").alias("rows"))


def pruned_diff(before: DataFrame, after: DataFrame, key: str, values: list[str], width: int) -> DataFrame:
    """``diff`` of only those segments whose digests differ; equal segments are not joined."""
    a, b = (segment_hashes(df, key, values, width) for df in (before, after))
    same = a.join(b, ["segment", "low", "high", "rows"], "left_semi").select("segment")
    rest = lambda df: df.withColumn("segment", F.floor(F.col(key) / width)).join(same, "segment", "left_anti").drop("segment")
    return diff(rest(before), rest(after), key, values)


def detail(changes: DataFrame, values: list[str]) -> DataFrame:
    """A row for each changed value of each modified row: key, column, before, after."""
    cells = F.array(*(F.struct(F.lit(v).alias("column"), F.col(f"from_{v}").cast("string").alias("before"), F.col(f"to_{v}").cast("string").alias("after")) for v in values))
    rows = changes.where(F.col("kind") == MODIFIED).select("key", F.explode(cells).alias("cell")).select("key", "cell.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The snapshot after the changes: what ``diff`` undoes."""
    untouched = snapshot.join(changes.select(F.col("key").alias(key)), key, "left_anti").select(key, *values)
    new = changes.where(F.col("kind") != REMOVED).select(F.col("key").alias(key), *(F.col(f"to_{v}").alias(v) for v in values))
    return untouched.unionByName(new)


def coalesce_edits(edits: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The last edit of each key: op and values, by a maximum with map-side combining; of equal places the greatest."""
    last = edits.groupBy(key).agg(F.max(F.struct(order, "op", *values)).alias("last"))
    return last.select(key, *(f"last.{c}" for c in ("op", *values)))


def upsert(snapshot: DataFrame, edits: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The snapshot with coalesced edits (op put or delete) applied."""
    kept = snapshot.join(edits.select(key), key, "left_anti").select(key, *values)
    return kept.unionByName(edits.where("op = 'put'").select(key, *values))
