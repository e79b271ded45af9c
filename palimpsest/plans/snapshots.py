"""Snapshots in segments: ranges of keys, each in files of its own with a digest of its rows.

A snapshot is a manifest, a Parquet table (segment, digest, rows, path), named
by a hash over segments and digests: equal rows make equal names, whatever the
order or the history that made them. Edits read and write only the segments
that they touch; a diff reads only segments whose digests differ, and none of
equal snapshots; a merge takes over segments that one side alone has changed.
What the driver holds is paths of the segments that are read, as Spark's own
file index does.

Keys are unique and not null; a null key is refused when it is written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from palimpsest.functions.hashing import row_hash
from palimpsest.operators import merge as merging
from palimpsest.operators.diff import diff, upsert

MANIFEST = "segment long, digest string, rows long, path string"


@dataclass(frozen=True)
class Schema:
    """Key and value columns of the datasets, the column that tells a row's model, and the width of segments.

    Segments are ranges of ``width`` integers; keys of other types are dealt
    to ``width`` segments by a hash.
    """

    key: str
    values: tuple[str, ...]
    model: str
    width: int = 1 << 20

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.values]


def _sums(text: Column) -> Column:
    """A digest of a set of hexadecimal hashes without their order: eight sums of 32 bits each, combined map-side."""
    parts = [F.sum(F.conv(F.substring(text, 1 + 8 * k, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, where: str) -> bool:
        return self.fs.exists(self._hadoop.Path(f"{self.path}/{where}"))

    def delete(self, where: str) -> None:
        self.fs.delete(self._hadoop.Path(f"{self.path}/{where}"), True)

    def _segment(self, rows: DataFrame) -> Column:
        key = F.col(self.schema.key)
        whole = isinstance(rows.schema[self.schema.key].dataType, IntegralType)
        number = F.floor(key / self.schema.width) if whole else F.pmod(F.xxhash64(key), F.lit(self.schema.width))
        return F.when(key.isNull(), F.raise_error(F.lit("a key is null")).cast("long")).otherwise(number.cast("long"))

    def _write(self, rows: DataFrame) -> DataFrame:
        """Files of the rows' segments, and their entries for a manifest."""
        columns = self.schema.columns
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*columns).withColumn("segment", self._segment(rows)).repartition("segment")
        dealt.sortWithinPartitions("segment", self.schema.key).write.partitionBy("segment").parquet(f"{self.path}/{folder}")
        kinds = StructType([*rows.select(*columns).schema.fields]).add("segment", "long")
        found = self.spark.read.schema(kinds).parquet(f"{self.path}/{folder}").groupBy("segment").agg(_sums(row_hash(*map(F.col, columns))).alias("digest"), F.count("*").alias("rows"))
        return found.withColumn("path", F.concat(F.lit(f"{folder}/segment="), F.col("segment").cast("string")))

    def _record(self, manifest: DataFrame, kinds: StructType) -> str:
        """Writes a manifest under the name that its segments give it."""
        staged = f"{self.path}/manifests/staged-{uuid.uuid4().hex}"
        manifest.select("segment", "digest", "rows", "path").write.parquet(staged)
        name = self.spark.read.schema(MANIFEST).parquet(staged).agg(_sums(row_hash(F.col("segment"), F.col("digest"))).alias("d")).select(F.sha2(F.concat(F.lit(kinds.json()), "d"), 256)).first()[0]
        if self.exists(f"manifests/{name}"):
            self.fs.delete(self._hadoop.Path(staged), True)
        else:
            self.fs.rename(self._hadoop.Path(staged), self._hadoop.Path(f"{self.path}/manifests/{name}"))
            self.delete(f"manifests/{name}/{staged.rsplit('/', 1)[1]}")  # where another writer was first, it has moved inside
        return name

    def write(self, rows: DataFrame) -> str:
        """The name of a stored snapshot of all the rows."""
        return self._record(self._write(rows), rows.select(*self.schema.columns).schema)

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def _read(self, entries: DataFrame, kinds: StructType) -> DataFrame:
        paths = [f"{self.path}/{r['path']}" for r in entries.where("path is not null").select("path").collect()]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def open(self, name: str, kinds: StructType) -> DataFrame:
        return self._read(self.manifest(name), kinds)

    def apply(self, name: str, edits: DataFrame, kinds: StructType) -> str:
        """The snapshot after edits (op put or delete, key, values; each key once): only their segments are read and written."""
        old = self.manifest(name)
        touched = edits.select(self._segment(edits).alias("segment")).distinct()
        rows = upsert(self._read(old.join(touched, "segment", "left_semi"), kinds), edits, self.schema.key, list(self.schema.values))
        new = self._write(rows)
        return self._record(old.join(touched, "segment", "left_anti").unionByName(new), kinds)

    def _sides(self, **names: str) -> DataFrame:
        out = None
        for side, name in names.items():
            own = self.manifest(name).select("segment", F.col("digest").alias(f"{side}_digest"), F.col("rows").alias(f"{side}_rows"), F.col("path").alias(f"{side}_path"))
            out = own if out is None else out.join(own, "segment", "full_outer")
        return out

    def changed_segments(self, a: str, b: str) -> DataFrame:
        """Entries of both sides for every segment whose digest is not the same."""
        return self._sides(a=a, b=b).where(~F.col("a_digest").eqNullSafe(F.col("b_digest")))

    def diff(self, a: str, b: str, kinds: StructType) -> DataFrame:
        """Changes from a to b; only segments that differ are read."""
        none = self.spark.createDataFrame([], kinds)
        key, values = self.schema.key, list(self.schema.values)
        if a == b:
            return diff(none, none, key, values)
        changed = self.changed_segments(a, b)
        x, y = (self._read(changed.select(F.col(f"{side}_path").alias("path")), kinds) for side in "ab")
        return diff(x, y, key, values)

    def merge(self, base: str, ours: str, theirs: str, strategy: merging.Strategy, max_conflicts: int, kinds: StructType) -> tuple[str, list]:
        """The merged snapshot and the conflicts; segments that one side alone has changed, or both alike, are not read."""
        sides = self._sides(b=base, o=ours, t=theirs)
        same = lambda x, y: F.col(f"{x}_digest").eqNullSafe(F.col(f"{y}_digest"))
        take = F.when(same("t", "b"), "o").when(same("o", "b"), "t")
        if not strategy.accumulates:
            take = take.when(same("o", "t"), "o")
        sides = sides.withColumn("take", take)
        entry = lambda side: sides.where(F.col("take") == side).where(f"{side}_path is not null").select("segment", F.col(f"{side}_digest").alias("digest"), F.col(f"{side}_rows").alias("rows"), F.col(f"{side}_path").alias("path"))
        manifest, both, conflicts = entry("o").unionByName(entry("t")), sides.where("take is null"), []
        if both.limit(1).count():
            s = self.schema
            rows = [self._read(both.select(F.col(f"{side}_path").alias("path")), kinds) for side in "bot"]
            merged, found = merging.merge(*rows, s.key, list(s.values), s.model, strategy, max_conflicts)
            conflicts = [list(r) for r in found.select("key", "class").orderBy("key").collect()]  # at most max_conflicts
            manifest = manifest.unionByName(self._write(merged))
        return self._record(manifest, kinds), conflicts

    def names(self, older_than: float) -> list[str]:
        """Manifests last changed before a time in seconds."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        found = self.fs.listStatus(folder) if self.fs.exists(folder) else []
        return sorted(f.getPath().getName() for f in found if f.getModificationTime() <= older_than * 1000)

    def sweep(self, older_than: float) -> int:
        """Deletes files of segments that no manifest names, last changed before a time; how many segments."""
        folder = self._hadoop.Path(f"{self.path}/data")
        if not self.fs.exists(folder):
            return 0
        here = [f"data/{w.getPath().getName()}/{s.getPath().getName()}" for w in self.fs.listStatus(folder) for s in self.fs.listStatus(w.getPath()) if s.isDirectory() and s.getPath().getName().startswith("segment=") and s.getModificationTime() <= older_than * 1000]
        if not here:
            return 0
        named = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/*").select("path").distinct()
        dead = [r["path"] for r in self.spark.createDataFrame([(x,) for x in here], "path string").join(named, "path", "left_anti").collect()]
        for path in dead:
            self.delete(path)
        return len(dead)
