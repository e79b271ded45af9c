"""Token counts with overlap resynchronisation.

A text of up to ``long_chars`` characters is encoded whole where it is read.
A longer one is cut into chunks that overlap, the chunks are dealt over the
cluster and encoded with offsets, and neighbours are spliced at a boundary
that both have and that is proven stable: no vocabulary piece holds the two
characters beside it next to each other, so no merge ever crosses it and the
pieces on either side can't depend on each other. The overlap widens, up to
the text's end, until it holds such a boundary; where the encoded chunks have
none in common all the same, the text is encoded whole.

Null and empty texts count no bytes and no tokens. Repeated rows are counted
each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, slices, stored

SPACE = "▁"


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def joined_pairs(path: str) -> frozenset[str]:
    """Every two characters that stand next to each other inside a vocabulary piece."""
    model = piece_model(path)
    pairs = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
    return frozenset(pairs)


def stable_boundary(text: str, start: int, overlap: int, pairs: frozenset[str]) -> tuple[int, int]:
    """The first stable boundary from ``start`` on, and the overlap that was wide enough to hold it.

    (len(text), overlap) if the rest of the text has none.
    """
    at = start
    while at < len(text):
        for at in range(max(at, start, 1), min(start + overlap, len(text))):  # noqa: B020
            if text[at - 1 : at + 1].replace(" ", SPACE) not in pairs:
                return at, overlap
        at = start + overlap
        overlap *= 2
    return len(text), overlap


def cut(text: str, chunk: int, overlap: int, pairs: frozenset[str]) -> list[tuple[int, int]]:
    """[start, end) of overlapping chunks; neighbours share at least one stable boundary, not at a chunk's own start."""
    out, start = [], 0
    while True:
        aim = start + chunk
        at, width = stable_boundary(text, aim + 1, overlap, pairs) if aim < len(text) else (len(text), overlap)
        if at >= len(text):
            out.append((start, len(text)))
            return out
        out.append((start, min(len(text), aim + 1 + width)))
        start = aim


CHUNKS = "row long, doc_id long, n_bytes long, n_chunks int, k int, start long, next long, chunk string"
COUNTED = "row long, doc_id long, n_bytes long, n_chunks int, k int, tokens long, head map<long,long>, tail map<long,long>"


def _encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for part in slices(batches, "text", 2_000_000):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = [len(ids) for ids in model.encode(texts, num_threads=1)] if texts else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut_long(path: str, chunk: int, overlap: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("k", pa.int32()), ("start", pa.int64()), ("next", pa.int64()), ("chunk", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = joined_pairs(path)
        for batch in batches:
            for row, doc_id, n_bytes, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes", "text")), strict=True):
                spans = cut(text, chunk, overlap, pairs)
                for first in range(0, len(spans), 64):
                    part = spans[first : first + 64]
                    starts = [s for s, _ in part]
                    after = [spans[first + i + 1][0] if first + i + 1 < len(spans) else len(text) for i in range(len(part))]
                    n = len(part)
                    yield pa.RecordBatch.from_pydict(
                        {"row": [row] * n, "doc_id": [doc_id] * n, "n_bytes": [n_bytes] * n, "n_chunks": [len(spans)] * n, "k": range(first, first + n), "start": starts, "next": after, "chunk": [text[s:e] for s, e in part]},
                        schema,
                    )

    return run


def _encode_chunks(path: str):
    marks = pa.map_(pa.int64(), pa.int64())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("k", pa.int32()), ("tokens", pa.int64()), ("head", marks), ("tail", marks)])

    def stable_starts(text: str, start: int, pairs: frozenset[str]) -> tuple[int, list[tuple[int, int]]]:
        """Pieces of the chunk, and (offset in the text, pieces before it) at every stable piece start."""
        pieces = piece_model(path).encode(text, return_type="proto").pieces  # their offsets count bytes
        chars = np.cumsum((np.frombuffer(text.encode() + b" ", np.uint8) & 0xC0) != 0x80) - 1
        found, seen = [], -1
        for i, piece in enumerate(pieces):
            at = int(chars[piece.begin])
            if 0 < at != seen and text[at - 1 : at + 1].replace(" ", SPACE) not in pairs:
                found.append((start + at, i))
            seen = at
        return len(pieces), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = joined_pairs(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, found = stable_starts(r["chunk"], r["start"], pairs)
                before = r["prev_end"]
                head = [x for x in found if before is not None and x[0] < before]
                tail = [x for x in found if r["k"] + 1 < r["n_chunks"] and x[0] >= r["next"]]
                rows.append({c: r[c] for c in ("row", "doc_id", "n_bytes", "n_chunks", "k")} | {"tokens": n, "head": head, "tail": tail})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, long_chars: int = 65_536, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), a row for each row of ``docs``.

    No limit of the tokenizer library's memory depends on a text's length:
    a task holds chunks of about ``chunk`` characters of long texts.
    """
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > long_chars
    short = rows.where(~is_long).mapInArrow(_encode_whole(model_path), "doc_id long, n_bytes long, n_tokens long")

    numbered = rows.where(is_long).withColumn("row", F.monotonically_increasing_id())
    chunks = numbered.select("row", "doc_id", "n_bytes", "text").mapInArrow(_cut_long(model_path, chunk, overlap), CHUNKS)
    by_row = Window.partitionBy("row").orderBy("k")
    chunks = chunks.withColumn("end", F.col("start") + F.char_length("chunk"))
    chunks = chunks.repartition("row", "k")
    ends = chunks.select("row", (F.col("k") + 1).alias("k"), F.col("end").alias("prev_end"))
    counted = (
        chunks.join(ends, ["row", "k"], "left")
        .select("row", "doc_id", "n_bytes", "n_chunks", "k", "start", "next", "prev_end", "chunk")
        .mapInArrow(_encode_chunks(model_path), COUNTED)
    )
    # The boundary with the next chunk is the first that both have; the sum telescopes from splice to splice.
    splice = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("next_head")))
    spliced = (
        counted.withColumn("next_head", F.lead("head").over(by_row))
        .withColumn("at", F.when(F.col("k") + 1 < F.col("n_chunks"), splice))
        .withColumn("from", F.lag("at").over(by_row))
        .withColumn("apart", (F.col("k") + 1 < F.col("n_chunks")) & F.col("at").isNull())
        .withColumn("n", F.coalesce(F.element_at("tail", F.col("at")), F.col("tokens")) - F.coalesce(F.element_at("head", F.col("from")), F.lit(0)))
    )
    # Of each long text a row; one whose chunks have no common boundary is encoded with the widest overlap, its whole length.
    long = stored(spliced.groupBy("row", "doc_id", "n_bytes").agg(F.sum("n").alias("n_tokens"), F.bool_or("apart").alias("apart")), "long")
    apart = long.where("apart").select("row")
    out = long.where(~F.col("apart")).select("doc_id", "n_bytes", "n_tokens")
    if apart.limit(1).count():
        whole = numbered.join(apart, "row", "left_semi").select("doc_id", "n_bytes", "text")
        out = out.unionByName(whole.mapInArrow(_encode_whole(model_path), "doc_id long, n_bytes long, n_tokens long"))
    long = out
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
