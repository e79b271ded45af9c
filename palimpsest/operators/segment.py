"""Content-defined segments: nodes of ordered maps and chunks of byte streams.

Where a segment ends depends on the entries since the last end, so each
ordered group is folded; the fold is an ``aggregate`` over its sorted array,
exact in 38-digit integers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least, usual and greatest bytes of a node, and the scale of its length's distribution.
MIN_NODE, TARGET_NODE, MAX_NODE = 512, 4096, 16384
SCALE = 4519


def node_ends(entries: DataFrame, group: str, order: str, size: str, window: str) -> DataFrame:
    """group and the 0-based places, in ``order``, of the entries that end a node.

    An entry ends its node once the node has ``MIN_NODE`` bytes, if it has
    ``MAX_NODE`` or if the entry's hash window is under
    (after**4 - before**4) * 2**32 / SCALE**4.
    """
    whole = "decimal(38,0)"
    power = lambda c: (c * c).cast(whole) * (c * c).cast(whole)

    def step(state, entry):
        before = state["size"]
        after = (before + entry["size"]).cast("long")
        gain = ((power(after) - power(before)).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(12,0)")).cast(whole)
        need = ((entry["window"] + 1).cast("decimal(12,0)") * F.lit(SCALE**4).cast("decimal(20,0)")).cast(whole)
        ends = (after >= MIN_NODE) & ((after >= MAX_NODE) | (need <= gain))
        at = state["at"]
        return F.struct(
            F.when(ends, F.lit(0).cast("long")).otherwise(after).alias("size"),
            (at + 1).alias("at"),
            F.when(ends, F.concat(state["ends"], F.array(at))).otherwise(state["ends"]).alias("ends"),
        )

    rows = entries.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("size"), F.col(window).cast("long").alias("window")))).alias("entries"))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return rows.select(group, F.aggregate("entries", start, step, lambda s: s["ends"]).alias("ends"))


@lru_cache(maxsize=4)
def gear(seed: str) -> np.ndarray:
    """256 values, each the first eight bytes of a hash of the seed and a number."""
    return np.array([int.from_bytes(hashlib.sha256(f"{seed}{i}".encode()).digest()[:8], "little") for i in range(256)], np.uint64)


WIDTH = 48  # bytes that the rolling hash covers
BLOCK = 1 << 21  # bytes hashed at a time


def rolling_hashes(data: np.ndarray, seed: str) -> np.ndarray:
    """At each byte: exclusive or of the values of the ``WIDTH`` bytes up to it, each rotated by its age; zeros come before.

    The hash of 2 w bytes is that of the last w and, rotated by w, that of the
    w before them; 32 and 16 bytes make ``WIDTH``.
    """
    n = WIDTH - 1
    h = gear(seed)[np.concatenate([np.zeros(n, np.uint8), data])]
    sixteen = None
    for w in (1, 2, 4, 8, 16):
        if w == 16:
            sixteen = h
        before = h[:-w]
        h = h.copy()
        h[w:] ^= before << np.uint64(w) | before >> np.uint64(64 - w)
    before = sixteen[n - 32 : len(h) - 32]
    return h[n:] ^ (before << np.uint64(32) | before >> np.uint64(32))


def hits(data: np.ndarray, mask: int, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Places after the bytes whose hash passes the hard mask, and after those that pass the easy one."""
    hard, easy = [], []
    for start in range(0, len(data), BLOCK):
        before = min(start, WIDTH - 1)  # bytes of the block before, of which the first hashes consist
        h = rolling_hashes(data[start - before : start + BLOCK], seed)[before:]
        some = np.flatnonzero((h & np.uint64(mask >> 2)) == 0)
        easy.append(some + start + 1)
        hard.append(some[(h[some] & np.uint64(mask << 2 | mask)) == 0] + start + 1)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(hard or none), np.concatenate(easy or none)


def _ends(hard: list[int], easy: list[int], begin: int, stop: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of the stream at data[begin:stop]."""
    ends, start = [], begin
    while start < stop:
        end = min(start + most, stop)
        h, e = bisect_left(hard, start + 1), bisect_left(easy, start + least)
        if h < len(hard) and hard[h] < min(start + least, end):
            end = hard[h]
        elif e < len(easy) and easy[e] < end:
            end = easy[e]
        ends.append(end)
        start = end
    return ends


def cut_points(data: bytes, least: int, most: int, mask: int, seed: str) -> list[int]:
    """Ends of chunks: hits of a hard mask below ``least`` bytes, of an easy one from there on, and at ``most``."""
    hard, easy = hits(np.frombuffer(data, np.uint8), mask, seed)
    return _ends(hard.tolist(), easy.tolist(), 0, len(data), least, most)


def chunks(streams: DataFrame, least: int = 16 << 10, most: int = 512 << 10, mask: int = 0xFFFF, seed: str = "palimpsest-") -> DataFrame:
    """stream, seq, bytes and hash of the chunks of each row's data. One row's data is one stream.

    A task hashes the streams of a batch together, with zeros between them; a
    null or empty stream has no chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = bytes(WIDTH - 1)
        for batch in batches:
            streams, data = batch.column("stream").to_pylist(), [x or b"" for x in batch.column("data").to_pylist()]
            first = 0
            while first < len(data):
                past, size = first, 0
                while past < len(data) and (past == first or size + len(data[past]) <= BLOCK):
                    size += len(data[past]) + WIDTH - 1
                    past += 1
                own = data[first:past]
                hard, easy = (x.tolist() for x in hits(np.frombuffer(gap.join(own), np.uint8), mask, seed))
                out: dict[str, list] = {"stream": [], "seq": [], "bytes": [], "hash": []}
                begin = 0
                for stream, x in zip(streams[first:past], own, strict=True):
                    start = 0
                    for seq, end in enumerate(_ends(hard, easy, begin, begin + len(x), least, most)):
                        out["stream"].append(stream)
                        out["seq"].append(seq)
                        out["bytes"].append(end - begin - start)
                        out["hash"].append(hashlib.sha256(x[start : end - begin]).hexdigest())
                        start = end - begin
                    begin += len(x) + WIDTH - 1
                yield pa.RecordBatch.from_pydict({"stream": pa.array(out["stream"], pa.int64()), "seq": pa.array(out["seq"], pa.int32()), "bytes": pa.array(out["bytes"], pa.int64()), "hash": pa.array(out["hash"], pa.string())})
                first = past

    return streams.select(F.col("stream").cast("long").alias("stream"), F.col("data").cast("binary").alias("data")).mapInArrow(run, "stream long, seq int, bytes long, hash string")
