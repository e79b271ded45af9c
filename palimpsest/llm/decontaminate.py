"""Benchmark decontamination by winnowing.

Both sides keep fingerprints: of every ``GRAMS`` consecutive k-gram hashes the
least, ties included. A window of ``WINDOW`` words that occurs on both sides
has the same least hash on both, so looking the documents' fingerprints up
among the benchmark's finds every shared window; each find is extended to the
windows around it, and these are compared word for word. An item of fewer
words is one window, looked up at every position.

The benchmark is cut by a hash of its rows into blocks of at most about
``block_bytes`` of text, and each block's index is broadcast in its turn and
looked up where documents are read, so no broadcast grows with the benchmark.
With one block documents are not shuffled; with more, each block's finds are
written, and all of them joined with the documents in the end. An item longer than a block is cut
into pieces that share ``WINDOW`` - 1 words.

Null and empty texts have no words. An item without words occurs nowhere; a
null item_id reads as the empty string. Repeated rows are judged each; other
columns are carried along or ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import few, slices, stored
from palimpsest.llm.textbytes import Words, alnum_class, byte_values, find_words, lowered, mix, window_hashes, word_hashes

WINDOW, GRAM = 13, 8
GRAMS = WINDOW - GRAM + 1
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LAST = np.uint64(2**64 - 1)


def winnow(hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The k-gram hash at every word, and where it is a fingerprint: the least of some window's."""
    n = len(hashes)
    grams = np.full(n, LAST, np.uint64)
    values, at = window_hashes(hashes, words, GRAM)
    grams[at] = values
    chosen = np.zeros(n, bool)
    if n >= WINDOW:
        starts = np.flatnonzero(words.text[: n - WINDOW + 1] == words.text[WINDOW - 1 :])
        least = grams[starts]
        for d in range(1, GRAMS):
            least = np.minimum(least, grams[starts + d])
        for d in range(GRAMS):
            chosen[starts[grams[starts + d] == least] + d] = True
    return grams, chosen


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index into the sorted ``known`` of each value, or -1."""
    if len(known) == 0:
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class Index:
    """Windows of one block of the benchmark, by hash, with the items that have them."""

    def __init__(self, items: list[str], texts: list[str]):
        seed = 1
        normal = [b" ".join(WORD.findall(t.encode().translate(LOWER))) for t in texts]
        column = pa.array([x.decode() for x in normal], pa.large_string())
        while not self._build(items, find_words(column, alnum_class()), seed):
            seed += 1

    def _build(self, items: list[str], words: Words, seed: int) -> bool:
        """False if two different windows have the same hash under this seed."""
        self.seed, counts = seed, words.counts()
        hashes = word_hashes(words, byte_values(seed))
        grams, chosen = winnow(hashes, words)
        self.fingerprints = np.unique(grams[chosen])
        self.sieve = np.zeros(1 << 20, bool)  # by the low bits: most other hashes end here
        self.sieve[self.fingerprints & np.uint64(self.sieve.size - 1)] = True
        self.windows, self.texts, self.lists = {}, {}, []
        known: dict[tuple[str, ...], int] = {}
        for size in sorted({min(int(c), WINDOW) for c in counts if c}):
            own = counts[words.text] >= WINDOW if size == WINDOW else counts[words.text] == size
            values, at = window_hashes(hashes, words, size)
            values, at = values[own[at]], at[own[at]]
            order = np.argsort(values, kind="stable")
            values, at = values[order], at[order]
            groups = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
            texts, ids = [], []
            for a, b in zip(groups, [*groups[1:], len(values)], strict=True):
                same = {words.data[words.start[i] : words.end[i + size - 1]].tobytes() for i in at[a:b]}
                if len(same) > 1:
                    return False
                texts.append(same.pop())
                having = tuple(sorted({items[t] for t in words.text[at[a:b]]}))
                ids.append(known.setdefault(having, len(known)))
            self.windows[size] = (values[groups], np.array(ids, np.int64))
            offsets = np.cumsum([0, *map(len, texts)])
            self.texts[size] = (b"".join(texts), offsets)
        self.lists = list(known)
        return True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of the block in these texts: its first word, its size, the id of its items' list."""
        hashes = word_hashes(words, lowered(byte_values(self.seed)))
        starts, sizes, ids = [], [], []
        for size, (values, lists) in self.windows.items():
            if size == WINDOW:
                at = self._extended(hashes, words)
                total = hashes[at].copy()
                for k in range(1, WINDOW):
                    total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
                seen = mix(total)
            else:
                seen, at = window_hashes(hashes, words, size)
            place = among(seen, values)
            at, place = at[place >= 0], place[place >= 0]
            blob, offsets = self.texts[size]
            low = words.data.tobytes().translate(LOWER) if len(at) else b""
            right = np.fromiter(
                (
                    blob[offsets[p] : offsets[p + 1]] == b" ".join(low[s:e] for s, e in zip(words.start[i : i + size], words.end[i : i + size], strict=True))
                    for i, p in zip(at, place, strict=True)
                ),
                bool,
                len(at),
            )
            starts.append(at[right])
            sizes.append(np.full(right.sum(), size))
            ids.append(lists[place[right]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(sizes or none), np.concatenate(ids or none)

    def _extended(self, hashes: np.ndarray, words: Words) -> np.ndarray:
        """First words of all windows around fingerprints that the block has too."""
        grams, chosen = winnow(hashes, words)
        at = np.flatnonzero(chosen)
        at = at[self.sieve[grams[at] & np.uint64(self.sieve.size - 1)]]
        at = at[among(grams[at], self.fingerprints) >= 0]
        around = np.unique((at[:, None] - np.arange(GRAMS)).ravel())
        around = around[(around >= 0) & (around + WINDOW <= len(hashes))]
        return around[words.text[around] == words.text[around + WINDOW - 1]]


SPANS = pa.list_(pa.int64())


def _finds(block: Index, words: Words, rows: int) -> tuple[list[list[int]], list[list[str]]]:
    """Of each text, in words: spans (starts and ends in turn) of its hit words, and the items."""
    starts, sizes, ids = block.find(words)
    hit = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + sizes, -1)
    hit = np.cumsum(hit[:-1]) > 0
    spans: list[list[int]] = [[] for _ in range(rows)]
    items: list[list[str]] = [[] for _ in range(rows)]
    # A run of hit words ends where its text ends.
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    run_starts, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for s, e in zip(run_starts.tolist(), run_ends.tolist(), strict=True):
        while s < e:
            t = int(words.text[s])
            stop = min(e, int(words.first[t + 1]))
            spans[t] += [s - int(words.first[t]), stop - int(words.first[t])]
            s = stop
    pairs = np.unique(np.stack([words.text[starts], ids], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
    texts, begins = np.unique(pairs[:, 0], return_index=True)
    for t, own in zip(texts.tolist(), np.split(pairs[:, 1], begins[1:]), strict=False):
        items[t] = sorted(set().union(*(block.lists[i] for i in own)))
    return spans, items


def _scan(index):
    """Every row with its n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = find_words(part.column("text"), alnum_class())
            spans, items = _finds(index.value, words, part.num_rows)
            yield pa.RecordBatch.from_pydict(
                {"row": part.column("row"), "doc_id": part.column("doc_id"), "n_words": pa.array(words.counts(), pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            )

    return run


def _hits(index):
    """key, spans and items of the rows that one block of the benchmark hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans, items = _finds(index.value, find_words(part.column("text"), alnum_class()), part.num_rows)
            hit = [t for t, x in enumerate(spans) if x]
            yield pa.RecordBatch.from_pydict(
                {"key": part.column("key").take(pa.array(hit, pa.int64())), "spans": pa.array([spans[t] for t in hit], SPANS), "items": pa.array([items[t] for t in hit], pa.list_(pa.string()))}
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their n_words, and their finds of all blocks as one list of spans and one of items."""
    for part in slices(batches, "text"):
        words = find_words(part.column("text"), alnum_class())
        spans, items = [], []
        for finds in part.column("finds").to_pylist():
            out: list[int] = []
            for s, e in sorted(x for f in finds or () for x in zip(f["spans"][::2], f["spans"][1::2], strict=True)):
                if out and s <= out[-1]:
                    out[-1] = max(out[-1], e)
                else:
                    out += [s, e]
            spans.append(out)
            items.append(sorted({i for f in finds or () for i in f["items"]}))
        yield pa.RecordBatch.from_pydict(
            {"row": part.column("row"), "doc_id": part.column("doc_id"), "n_words": pa.array(words.counts(), pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))}
        )


def _pieces(size: int):
    """Long items cut into pieces of about ``size`` words that overlap by WINDOW - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = WORD.findall((text or "").encode().translate(LOWER))
                for k in range(0, max(1, len(words) - WINDOW + 1), size):
                    if words:
                        items.append(item)
                        pieces.append(b" ".join(words[k : k + size + WINDOW - 1]).decode())
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "text": pa.array(pieces, pa.string())})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, carry: bool = False, block_bytes: int = 8_000_000, max_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated, and spans and items themselves.

    ``block_bytes`` bounds what is gathered and broadcast at a time; finds of
    up to ``max_rows`` documents are broadcast, more are joined. With
    ``carry``, the rows' own columns come as the struct ``row``.
    """
    spark = docs.sparkSession
    pieces = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    pieces = stored(pieces.distinct().mapInArrow(_pieces(max(100, block_bytes // 64)), "item string, text string"), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // block_bytes
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))

    row = F.struct(*(docs[c] for c in docs.columns)) if carry else F.struct(F.lit(1).alias("none"))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, n_words long, spans array<long>, items array<string>"

    def index(block: int):
        own = pieces.where(F.col("block") == block).select("item", "text").toArrow()
        return spark.sparkContext.broadcast(Index(own.column("item").to_pylist(), own.column("text").to_pylist()))

    if n_blocks == 1:
        rows = rows.mapInArrow(_scan(index(0)), kinds)
    else:
        # Of each block only what it hits is written; the documents are read again for the next, and joined with all hits once.
        keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
        hits = None
        for block in range(n_blocks):
            own = stored(keyed.select("key", "text").mapInArrow(_hits(index(block)), "key long, spans array<long>, items array<string>"), "hits")
            hits = own if hits is None else hits.unionByName(own)
        finds = stored(hits.groupBy("key").agg(F.collect_set(F.struct("spans", "items")).alias("finds")), "finds")  # one of each block
        rows = keyed.join(few(finds, max_rows), "key", "left").select("row", "doc_id", "text", "finds").mapInArrow(_merged, kinds)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, F.col("spans")[i]).otherwise(-F.col("spans")[i]))
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return (
        rows.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select(*(["row"] if carry else []), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns and no others."""
    return contamination(docs, benchmark, carry=True, **options).where(~F.col("contaminated")).select("row.*")
