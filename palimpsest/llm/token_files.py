"""Token ids in files, in canonical length-limited Huffman codes.

Texts are tokenized where they are read, and the ids kept in the shared
folder. Counts of all ids give code lengths of at most ``MAX_BITS`` by
package-merge; canonical codes follow from the lengths alone. Each document is
coded from a byte boundary on, with the bit offset of every ``EVERY``-th id as
a checkpoint. Documents are dealt to shards by ranges of doc_id, and each
shard is written in ascending doc_id order as blocks: rows of a Parquet file
with document ids, numbers of ids, checkpoints and payload. A block is read by
itself: a table of ``MAX_BITS`` bits gives symbol and length, and all
checkpoints of a block are decoded in step.

A null or empty text is the end id alone. Null doc_ids come first; rows with
one doc_id follow in the order of a hash of their text. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, drop_stored, few, shared_dir, slices, stored
from palimpsest.llm.textbytes import column_bytes

MAX_BITS, EVERY, BLOCK = 18, 256, 262_144
#: White space as the tokenizers library takes it.
WHITE = "\t-\r \x85\xa0  -     　"
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: A piece ends where no token of a byte-level BPE can go on: before white space, and between a Latin word and these marks.
PIECE = re.compile(f"[ ]?[{LATIN}]+(?=[.,;:!?*&%$#|{WHITE}]|$)|[ ]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Classes of characters: white space, Latin letters, marks that end a Latin word; 0 is all others.
SPACE, LETTER, MARK = 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each character up to the highest white space, its class."""
    out = np.zeros(0x3001, np.uint8)
    for number, members in ((SPACE, WHITE), (LETTER, LATIN), (MARK, ".,;:!?*&%$#|")):
        out[[ord(c) for c in re.findall(f"[{members}]", "".join(map(chr, range(len(out)))))]] = number
    return out


def pieces_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces that ``PIECE`` finds in each text of UTF-8, end to end, and where each text's begin, with the end.

    Only ends of runs of a class are looked at, as pieces end nowhere else but
    before the last white space of several.
    """
    ends = np.cumsum([0, *map(len, texts)])
    joined = b"".join(texts)
    data, table = np.frombuffer(joined, np.uint8), _classes()
    kind = np.r_[table[:128], np.zeros(128, np.uint8)][data]
    for low, high, octets in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3)):
        at = np.flatnonzero((data >= low) & (data <= high))
        code = data[at] & np.int32(0x3F >> (octets - 1))
        for k in range(1, octets):
            code = code << 6 | (data[at + k] & 0x3F)
        own = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 0)
        for k in range(octets):
            kind[at + k] = own
    text_begins = np.zeros(len(data) + 1, bool)
    text_begins[ends] = True
    begins = text_begins[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    own, first = kind[run], text_begins[run]
    before, twice = np.r_[0, own[:-1]], np.r_[0, 0, own[:-2]][: len(own)]
    after_first = np.r_[False, first[:-1]]
    after_space = ~first & (own != SPACE) & (before == SPACE)
    cut = first | (~first & (own == SPACE)) | (after_space & (data[run - 1] != 32)) | (~first & (own == MARK) & (before == LETTER) & (after_first | (twice == SPACE)))
    word = run[after_space]
    last = word - 1
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    last = last[last > run[np.flatnonzero(after_space) - 1]]
    at = np.sort(np.r_[run[cut], last])
    offsets = np.r_[at, len(data)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]), np.searchsorted(at, ends).astype(np.int32)


@lru_cache(maxsize=2)
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


class PieceCoder:
    """Ids of texts by the tokenizers library; each distinct piece is encoded once as long as it is remembered."""

    REMEMBERED = 1_500_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        space = self.library.encode(" a", add_special_tokens=False).tokens[0][:1]
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith(space) for i in range(size)])
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.REMEMBERED:
            self.known = {}
            new = pieces
        led = [p for p in new if p[0] == " " and len(p) > 1]
        # Pieces led by a space keep their ids in a row of others: each begins with the one token that opens with it.
        for at in range(0, len(led), 4000):
            part = led[at : at + 4000]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(part):
                data, step = ids.tobytes(), self.dtype.itemsize
                for p, a, b in zip(part, begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
                    self.known[p] = data[a * step : b * step]
            else:
                self.known.update((p, self.whole(p)) for p in part)
        rest = [p for p in new if not (p[0] == " " and len(p) > 1)]
        for at in range(0, len(rest), 4000):
            part = rest[at : at + 4000]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(t in x for t in self.added) for x in texts]
        pieces, offsets = pieces_of([x.encode() if p else b"" for x, p in zip(texts, plain, strict=True)])
        # Arrow finds the distinct pieces and puts their ids in the pieces' places.
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        placed = pa.array(map(self.known.__getitem__, distinct), pa.binary(), size=len(distinct)).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), placed), pa.scalar(b"", pa.binary())).to_pylist()
        return [x if p else self.whole(t) for x, p, t in zip(joined, plain, texts, strict=True)]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for part in slices([batch], "text", 4_000_000):
                ids = [x + end for x in coder.encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "tie": part.column("tie"), "ids": pa.array(ids, pa.binary())})

    return run


def _counts(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(column_bytes(batch.column("ids"))[0].view(dtype), minlength=len(total))
            own[: len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return run


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Of each symbol with a count, the length of its code, none over ``limit``, by package-merge.

    ``limit`` grows where there are more symbols than codes of that length.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    # Each level: which of the cheapest items are leaves; pairs of the level before are packages.
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(weights) // 2 * 2
        packages = weights[0:m:2] + weights[1:m:2]
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        weights = both[by]
        is_leaf.append(by < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: among codes of one length, ids ascend."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        steps = np.left_shift(np.int64(1), self.bits - self.lengths)
        begins = np.cumsum(steps) - steps  # left-aligned codes
        size = int(self.ids.max(initial=0)) + 1
        self.length_of = np.zeros(size, np.int64)
        self.code_of = np.zeros(size, np.uint64)
        self.length_of[self.ids] = self.lengths
        self.code_of[self.ids] = (begins >> (self.bits - self.lengths)).astype(np.uint64)
        self._steps = steps

    @property
    def table(self) -> np.ndarray:
        """Of the next ``bits`` bits: 32 times the id, plus its code's length."""
        if not hasattr(self, "_table"):
            table = np.repeat(32 * self.ids + self.lengths, self._steps)
            self._table = np.append(table, np.ones((1 << self.bits) - len(table), np.int64)).astype(np.int32)
        return self._table

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Payload and checkpoints of documents of ``sizes`` ids each, none empty, laid end to end."""
        length = self.length_of[ids]
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(length) - length
        bits = np.add.reduceat(length, first)
        octets = (bits + 7) // 8
        start = np.cumsum(octets) - octets
        at = before + np.repeat(8 * start - before[first], sizes)
        code = self.code_of[ids] << (U64 - length.astype(np.uint64))
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        # A code of at most 32 bits lies in two 32-bit words; codes don't overlap, so sums are unions.
        code >>= shift
        n_words = int(octets.sum()) // 4 + 3
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(n_words, np.uint64)
        out[word[heads]] += np.add.reduceat(code >> HALF, heads)
        out[word[heads] + 1] += np.add.reduceat(code & LOW, heads)
        data = out.astype(">u4").tobytes()
        per = (sizes + EVERY - 1) // EVERY
        doc = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        marks = at[first[doc] + EVERY * nth] - 8 * start[doc]
        return [data[s : s + o] for s, o in zip(start.tolist(), octets.tolist(), strict=True)], np.split(marks, np.cumsum(per)[:-1])

    def decode(self, data: bytes, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids at each checkpoint (a bit offset, and how many ids follow from it), end to end."""
        table = self.table
        octets = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        wide = (octets[:-3] << 24) | (octets[1:-2] << 16) | (octets[2:-1] << 8) | octets[3:]
        mask = np.uint32((1 << self.bits) - 1)
        out = np.zeros((len(marks), int(counts.max(initial=0))), np.int32)
        at = marks.astype(np.int64).copy()
        by = np.argsort(-counts, kind="stable")
        at, left = at[by], counts[by]
        live = len(by)
        for k in range(out.shape[1]):
            while live and left[live - 1] <= k:
                live -= 1
            here = at[:live]
            look = (wide[here >> 3] >> (32 - self.bits - (here & 7)).astype(np.uint32)) & mask
            found = table[look]
            out[:live, k] = found >> 5
            at[:live] = here + (found & 31)
        back = np.empty_like(out)
        back[by] = out
        return back[np.arange(out.shape[1])[None, :] < counts[:, None]]


U64, HALF, LOW = np.uint64(64), np.uint64(32), np.uint64(2**32 - 1)
BLOCKS = "shard int, block int, first long, doc_ids array<long>, sizes array<int>, octets array<int>, marks array<int>, payload binary"


def _pack(code, dtype: str):
    """Documents of one shard, in order, coded and packed into blocks of at least ``BLOCK`` ids."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("sizes", "octets", "marks")), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: Code = code.value
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, marks, payload, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            whole = {"shard": shard, "block": block, "first": first, "doc_ids": docs, "sizes": sizes, "octets": [len(p) for p in payload], "marks": marks, "payload": b"".join(payload)}
            return pa.RecordBatch.from_pylist([whole], schema)

        for part in slices(batches, "ids", 400_000):
            raw, offsets = column_bytes(part.column("ids"))
            counts = np.diff(offsets) // np.dtype(dtype).itemsize
            coded, places = own.encode(raw.view(dtype), counts)
            for doc_id, n, data, places_of in zip(part.column("doc_id").to_pylist(), counts.tolist(), coded, places, strict=True):
                docs.append(doc_id)
                sizes.append(n)
                marks.extend(places_of.tolist())
                payload.append(data)
                held += n
                if held >= BLOCK:
                    yield row()
                    block, first = block + 1, first + held
                    docs, sizes, marks, payload, held = [], [], [], [], 0
        if docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_ids: int = 8_000_000) -> DataFrame:
    """Writes the files under ``path``; returns the code book (id, bits), which is written beside them.

    The code book has a row for each id that occurs, so at most one for each
    entry of the vocabulary. A shard holds about ``shard_ids`` ids.
    """
    spark = docs.sparkSession
    rows = documents(docs).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    tokens = stored(rows.select("doc_id", "tie", "text").mapInArrow(_tokenize(tokenizer_path, end_id), "doc_id long, tie long, ids binary"), "tokens")
    dtype = piece_coder(tokenizer_path).dtype.str
    counts = tokens.select("ids").mapInArrow(_counts(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    lengths = code_lengths(n, MAX_BITS)
    code = spark.sparkContext.broadcast(Code(ids, lengths))

    shards = max(1, round(int(n.sum()) / shard_ids))
    # The last key splits rows that are equal in all others, whose order is of no account.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.monotonically_increasing_id()]
    dealt = tokens.repartitionByRange(shards, *order).sortWithinPartitions(*order[:2])
    dealt.select("doc_id", "ids").mapInArrow(_pack(code, dtype), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_stored(tokens)
    book = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id long, bits int")
    book.write.parquet(f"{path}/book")
    return book


def _decode(code):
    """Every document's ids, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Code = code.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                sizes, octets = (np.array(row[c].as_py(), np.int64) for c in ("sizes", "octets"))
                per = (sizes + EVERY - 1) // EVERY
                doc = np.repeat(np.arange(len(sizes)), per)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                marks = np.array(row["marks"].as_py(), np.int64) + 8 * (np.cumsum(octets) - octets)[doc]
                ids = own.decode(row["payload"].as_py(), marks, np.minimum(EVERY, sizes[doc] - nth * EVERY))
                ends = np.cumsum(sizes)
                n = len(sizes)
                data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * np.r_[0, ends]), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"].as_py()] * n, pa.int32()),
                        "doc_id": row["doc_ids"].values,
                        "local": pa.array(row["first"].as_py() + ends - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids": data.cast(pa.binary()),
                    }
                )

    return run


def read_token_files(spark, path: str, max_broadcast: int = 500_000) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids, read from the files under ``path``.

    Up to ``max_broadcast`` shards, their places are broadcast; more are joined.
    """
    book = spark.read.parquet(f"{path}/book").toPandas()
    code = spark.sparkContext.broadcast(Code(book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row a shard, so a window over them all is small.
    totals = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    found = blocks.mapInArrow(_decode(code), "shard int, doc_id long, local long, n_tokens long, ids binary")
    return found.join(few(bases, max_broadcast), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token files of ``docs`` in the shared folder and reads them back."""
    path = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, end_id, path)
    return read_token_files(docs.sparkSession, path)

