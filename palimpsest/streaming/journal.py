"""Commits from a stream: each micro-batch is one commit, made once.

A stream is known by the id that Spark keeps in its checkpoint folder. The
repository's state holds the last batch of each stream, changed together with
the branch's head: a batch that is handed over again after a failure is passed
over, and other streams to the same branch have numbers of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.catalog import Repository


def stream_id(spark, checkpoint: str) -> str:
    """The id in a checkpoint folder's metadata, there before the first batch is handed over."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def commit_stream(edits: DataFrame, repository: Repository, branch: str, order: str, author: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Edits (op, key, values, order) applied to a branch, one commit a micro-batch."""

    def publish(batch: DataFrame, number: int) -> None:
        name = stream_id(repository.spark, checkpoint)
        repository.publish(branch, batch, order, author, f"batch {number} of {name}", stream=(name, number))

    return edits.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
