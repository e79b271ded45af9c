"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    """For local sessions that name no folder, as in tests."""
    return tempfile.mkdtemp(prefix="palimpsest-")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session that names none has a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/palimpsest/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends, and a lost executor costs no more than its task."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_parts(df: DataFrame, folder: str, by: str) -> dict[int, str]:
    """``df`` written as Parquet to a new ``folder``, and where the rows of each value of the integer column ``by`` lie, without that column."""
    df.write.option("compression", "zstd").partitionBy(by).parquet(folder)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return {int(name.split("=")[1]): f"{folder}/{name}" for name in names if name.startswith(f"{by}=")}


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*tables: DataFrame | None) -> None:
    """Delete the files behind ``stored`` DataFrames that nothing reads any more."""
    for df in tables:
        if folder := getattr(df, "stored_at", None):
            drop_folder(df.sparkSession, folder)
