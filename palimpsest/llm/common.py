"""Helpers that the training-data operators share."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.storage import drop_stored, shared_dir, stored

__all__ = ["BATCH_CHARS", "documents", "drop_stored", "few", "read", "shared_dir", "slices", "stored", "tokenizer_path"]

#: Characters of text that a Python task holds at once, but for a single longer text.
BATCH_CHARS = 8_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def few(ids: DataFrame, bound: int) -> DataFrame:
    """``ids`` with a broadcast hint if a count shows at most ``bound`` rows."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose ``column`` holds about ``chars`` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(itertools.chain(sizes, [0])):
            if i == len(sizes) or (held and held + n > chars):
                if i > start:
                    yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
