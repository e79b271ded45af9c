"""Removal of repeated byte strings with suffix arrays.

A string of ``length`` bytes is known by its minimizer, which equal strings
have at the same place. Neighbouring strings of a text with one minimizer are
a record: the bytes from the first one's start to the last one's end are its
context, and a hash of the bytes from the minimizer on that lie in all strings
with it is its core. Only records whose core occurs twice can hold a repeat.
Of these, equal contexts repeat as a whole. What is left are contexts of one
core that differ, as at the edges of a shared passage: they go to a task by
their core, which cuts them into phrases by content, builds the suffix array of
the phrases by linear grouping, and reads from its intervals of common prefixes
which strings occur twice (see ``repeats``).

A core with over ``max_group`` different contexts is not gathered: its records
are split by the distance from string to minimizer, which makes the cores
longer and the groups smaller, down to single strings, which are only counted.
Counts are Spark aggregates with map-side combining, so copies may make up any
share of the rows.

A null text is empty, and nothing is removed from it. A text of fewer than
``length`` bytes keeps all. Repeated rows repeat each other: both lose what
they share. Other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_stored, slices, stored
from palimpsest.llm.suffix import GRAM, Sums, minimizers, suffix_array
from palimpsest.llm.textbytes import BASE, U, byte_values, column_bytes, mix

TRIGGER = 8  # bytes that decide whether a phrase begins with them; one in 16 does
RECORD = "rid long, did long, at long, lo long, hi long, core long, c1 long, c2 long"
CONTEXT = "rid long, did long, at long, lo long, hi long, core long, c1 long, c2 long, weight int, bytes binary"
SPAN = "rid long, did long, s long, e long"
STEP = 4  # by which ranges of distances shrink when a core's records are split


def window_of(length: int) -> int:
    """Places for a minimizer in a string of ``length`` bytes: distances from string to minimizer are less."""
    if length < 2 * GRAM:
        raise ValueError(f"strings are at least {2 * GRAM} bytes long")
    return 1 << (length * 13 // 20).bit_length() - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _records(length: int):
    window = window_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            data, offsets = column_bytes(part.column("text"))
            one = Sums(data, 11)
            text, at, lo, hi = minimizers(data, offsets, length, window, one)
            core = one.hash(at, at + length - window + 1)
            c1 = one.hash(lo, hi + length)
            del one
            span = mix((at - lo).astype(np.uint64) * U(window) + (at - hi).astype(np.uint64))
            c2 = Sums(data, 12).hash(lo, hi + length) ^ span
            rows, base = pa.array(text), offsets[text]
            yield pa.RecordBatch.from_pydict(
                {"rid": part.column("rid").take(rows), "did": part.column("did").take(rows), "at": pa.array(at - base), "lo": pa.array(lo - base), "hi": pa.array(hi - base)}
                | {"core": _signed(core), "c1": _signed(c1), "c2": _signed(c2)}
            )

    return run


def _contexts(length: int):
    """The bytes of each wanted record, cut from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("rid", "did", "at", "lo", "hi", "core", "c1", "c2")), ("weight", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            for rid, did, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("rid", "did", "text", "wanted")), strict=True):
                data = text.encode()
                yield pa.RecordBatch.from_pylist([w | {"rid": rid, "did": did, "bytes": data[w["lo"] : w["hi"] + length]} for w in wanted], schema)

    return run


def phrases(data: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places where phrases begin: which they are, the ``TRIGGER`` bytes there tell, if they lie in one context."""
    n = len(data) - TRIGGER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(TRIGGER):
        gram = gram << U(8) | data[k : n + k]
    at = np.flatnonzero(mix(gram) >> U(60) == 0)
    return at[at + TRIGGER <= ends[of[at]]]


def repeats(spans: np.ndarray, weight: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """Whether the string at each start (column) of each context (row) occurs twice among them.

    Context i has strings at its first ``spans[i]`` bytes; one that stands for
    several equal ones has a weight of 2. The contexts are cut into phrases
    that depend on their bytes alone, each ending with the bytes that begin
    the next: none is a prefix of another, so phrases in the order of their
    bytes are symbols whose suffix array is that of the bytes at all phrases'
    starts. Strings are equal if they have the same bytes before their first
    phrase, and lie in one interval of the array whose common prefixes cover
    the rest.
    """
    n = len(contexts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    of = np.repeat(np.arange(n), sizes)
    at = phrases(data, ends, of)
    own = of[at]
    last = np.r_[own[1:] != own[:-1], True][: len(at)]
    stops = np.where(last, ends[own], np.r_[at[1:] + TRIGGER, 0][: len(at)])
    whole = data.tobytes()
    cut = [whole[a:b] for a, b in zip(at.tolist(), stops.tolist(), strict=True)]
    rank = {p: k for k, p in enumerate(sorted(set(cut)), 1)}
    symbols = np.zeros(len(at) + n, np.int64)  # 0 ends a context
    place = np.arange(len(at)) + own
    symbols[place] = [rank[p] for p in cut]
    row_of = np.full(len(symbols), -1, np.int64)
    row_of[place] = np.arange(len(at))
    order = row_of[np.array(suffix_array(symbols.tolist()), np.int64)]
    order = order[order >= 0]
    gap = np.where(np.r_[True, own[1:] != own[:-1]][: len(at)], at - begins[own] + 1, at - np.r_[0, at[:-1]][: len(at)])[order]
    at, own = at[order], own[order]
    common = _common(data, at, ends[own], length)

    found, seen = np.zeros((n, int(spans.max())), bool), np.zeros((n, int(spans.max())), bool)
    values, before = byte_values(13), np.zeros(len(at), np.uint64)
    live = np.arange(len(at))
    for r in range(length - TRIGGER + 1):
        live = live[gap[live] > r]
        if not len(live):
            break
        if r:
            before[live] = before[live] * BASE + values[data[at[live] - r]]
        start = at[live] - r - begins[own[live]]
        inside = start < spans[own[live]]
        row, start = live[inside], start[inside]
        seen[own[row], start] = True
        if len(row):
            interval = np.r_[0, np.cumsum(common < length - r)][row].astype(np.uint64)
            again = _twice(mix(before[row] ^ mix(interval + U(1))), weight[own[row]])
            found[own[row[again]], start[again]] = True
    # Strings without a phrase's start, as in runs of one character.
    c, start = np.nonzero(~seen & (np.arange(seen.shape[1]) < spans[:, None]))
    if len(c):
        again = _twice(Sums(data, 14).hash(begins[c] + start, begins[c] + start + length), weight[c])
        found[c[again], start[again]] = True
    return found


def _common(data: np.ndarray, at: np.ndarray, ends: np.ndarray, most: int, step: int = 4096) -> np.ndarray:
    """Bytes, up to ``most``, that each place and the next one have in common before a context's end."""
    padded = np.r_[data, np.zeros(most, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, most)
    out = np.empty(max(len(at) - 1, 0), np.int64)
    for k in range(0, len(out), step):
        differ = rows[at[k : k + step + 1]]
        differ = differ[1:] != differ[:-1]
        out[k : k + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    room = ends - at
    return np.minimum(out, np.minimum(room[1:], room[:-1])) if len(out) else out


def _twice(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the rows whose key has a total weight of 2 or more."""
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    total = np.add.reduceat(weight[by], first)
    return by[np.repeat(total >= 2, np.diff(np.r_[first, len(by)]))]


def _bundles(length: int, bundle: int):
    """Spans of repeated strings; the rows come sorted by core, and whole cores are taken ``bundle`` rows at a time."""
    names = ("rid", "did", "at", "lo", "hi", "core", "c1", "c2", "weight")

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        t = {c: table.column(c).to_numpy() for c in names}
        # Identical rows may have been fetched twice, from repeated rows.
        same = np.r_[False, (t["core"][1:] == t["core"][:-1]) & (t["c1"][1:] == t["c1"][:-1]) & (t["c2"][1:] == t["c2"][:-1])]
        rows = np.flatnonzero(~same)
        t = {c: v[rows] for c, v in t.items()}
        contexts = table.column("bytes").take(pa.array(rows)).to_pylist()
        found = repeats(t["hi"] - t["lo"] + 1, t["weight"], contexts, length) & (t["weight"] < 2)[:, None]
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        lo = t["lo"][i]
        return pa.RecordBatch.from_pydict({"rid": pa.array(t["rid"][i]), "did": pa.array(t["did"][i]), "s": pa.array(lo + first), "e": pa.array(lo + past - 1 + length)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            core = batch.column("core").to_numpy()
            cuts = np.flatnonzero(core[1:] != core[:-1]) + 1
            start = 0
            if held and len(core) and held[-1].column("core")[-1].as_py() != core[0] and n >= bundle:
                yield solve(held)
                held, n = [], 0
            for cut in cuts:
                if n + cut - start >= bundle:
                    held.append(batch.slice(start, cut - start))
                    yield solve(held)
                    held, n, start = [], 0, int(cut)
            if start < len(core):
                held.append(batch.slice(start))
                n += len(core) - start
        if held:
            yield solve(held)

    return run


def _split(length: int, size: int):
    """Contexts cut into those of ranges of ``size`` distances, with new cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes", 2_000_000):
            data, offsets = column_bytes(part.column("bytes").cast(pa.large_binary()))
            t = {c: part.column(c).to_numpy() for c in ("at", "lo", "hi")}
            far, near = t["at"] - t["lo"], t["at"] - t["hi"]
            n_ranges = far // size - near // size + 1
            row = np.repeat(np.arange(len(far)), n_ranges)
            k = near[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(n_ranges) - n_ranges, n_ranges)
            most, least = np.minimum(far[row], k * size + size - 1), np.maximum(near[row], k * size)
            lo, hi = t["at"][row] - most, t["at"][row] - least
            base = offsets[row] - t["lo"][row]  # of the text's offsets in data
            one = Sums(data, 11)
            core_start, core_end = base + t["at"][row] - k * size, base + t["at"][row] + length - (k * size + size - 1)
            core = one.hash(core_start, core_end) ^ mix(k.astype(np.uint64) + U(size) * U(1000003))
            c1 = one.hash(base + lo, base + hi + length)
            c2 = Sums(data, 12).hash(base + lo, base + hi + length) ^ mix(most.astype(np.uint64) * U(window_of(length)) + least.astype(np.uint64))
            whole = data.tobytes()
            rows = pa.array(row)
            yield pa.RecordBatch.from_pydict(
                {c: part.column(c).take(rows) for c in ("rid", "did", "at")}
                | {"lo": pa.array(lo), "hi": pa.array(hi), "core": _signed(core), "c1": _signed(c1), "c2": _signed(c2), "weight": part.column("weight").take(rows)}
                | {"bytes": pa.array([whole[a:b] for a, b in zip((base + lo).tolist(), (base + hi + length).tolist(), strict=True)], pa.binary())}
            )

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 16_000_000):
            sizes, removed, counts, kept, texts = [], [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                pieces, at, runs = [], 0, 0
                end = -1
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if s > end:
                        runs += 1
                        pieces.append(data[at:s])
                    end = max(end, e)
                    at = end
                pieces.append(data[at:])
                left = b"".join(pieces)
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                counts.append(runs)
                kept.append(left)
                texts.append(None if text is None else left.decode(errors="ignore"))
            yield pa.RecordBatch.from_pydict(
                {"row": part.column("row"), "doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                | {"n_spans": pa.array(counts, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_text": pa.array(texts, pa.string())}
            )

    return run


def _repeated(rows: DataFrame, weight) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of records with core, c1, c2: the distinct contexts that occur twice, those whose core has others, and all of them, stored."""
    firsts = [F.first(c).alias(c) for c in rows.columns if c not in {"c1", "c2", "weight"}]
    contexts = stored(rows.groupBy("c1", "c2").agg(F.sum(weight).alias("times"), *firsts), "contexts")
    mixed = contexts.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = contexts.join(mixed.hint("merge"), "core").withColumn("weight", F.least("times", F.lit(2)).cast("int"))
    return contexts.where("times > 1").select("c1", "c2"), wanted, contexts


def repeated_spans(texts: DataFrame, length: int, max_group: int, bundle: int) -> DataFrame:
    """rid, did, s, e: spans of the texts (rid, did, text) that repeated strings cover; they may overlap.

    Joins of what grows with the input are sort-merge joins at every size, so
    that Spark may split common keys, and costs grow as the input does.
    """
    records = stored(texts.where(F.octet_length("text") >= length).mapInArrow(_records(length), RECORD), "records")
    cores = stored(records.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    twice = stored(records.join(cores.hint("merge"), "core", "left_semi"), "twice")
    drop_stored(records, cores)
    again, wanted, contexts = _repeated(twice, F.lit(1))
    spans = [stored(twice.join(again.hint("merge"), ["c1", "c2"], "left_semi").select("rid", "did", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")), "spans")]
    drop_stored(twice)

    fields = F.struct("at", "lo", "hi", "core", "c1", "c2", "weight", "kinds")
    of_text = stored(wanted.groupBy("rid", "did").agg(F.collect_list(fields).alias("wanted")), "wanted")
    kinds = stored(wanted.where(F.col("kinds") > max_group).select("core").distinct(), "large")
    drop_stored(contexts)
    # A context is cut from one text that has it: repeated rows give it more than once, and one is taken.
    with_text = texts.join(of_text.hint("merge"), ["rid", "did"])
    cut = with_text.select("rid", "did", "text", F.transform("wanted", lambda w: w.dropFields("kinds")).alias("wanted")).mapInArrow(_contexts(length), CONTEXT)
    pieces = stored(cut, "pieces")
    drop_stored(of_text)

    size = window_of(length)
    while True:
        large, done = None, [pieces, kinds]
        small = pieces
        if kinds.limit(1).count():
            small = pieces.join(kinds.hint("merge"), "core", "left_anti").select(*pieces.columns)
            large = pieces.join(kinds.hint("merge"), "core", "left_semi").select(*pieces.columns)
        spans.append(stored(small.repartition("core").sortWithinPartitions("core", "c1", "c2").mapInArrow(_bundles(length, bundle), SPAN), "spans"))
        if large is None:
            drop_stored(*done)
            break
        size //= STEP
        rows = stored(large.dropDuplicates(["core", "c1", "c2"]).mapInArrow(_split(length, size), CONTEXT), "split")
        drop_stored(*done)
        again, wanted, contexts = _repeated(rows.drop("bytes"), F.col("weight"))
        spans.append(stored(rows.where("weight = 1").join(again.hint("merge"), ["c1", "c2"], "left_semi").select("rid", "did", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")), "spans"))
        wanted = stored(wanted.select("rid", "did", "at", "lo", "hi", "core", "c1", "c2", "weight", "kinds"), "wanted")
        kinds = stored(wanted.where(F.col("kinds") > max_group).select("core").distinct(), "large")
        keys = ["rid", "did", "at", "lo", "hi", "core", "c1", "c2"]
        pieces = stored(wanted.drop("kinds").join(rows.select(*keys, "bytes").hint("merge"), keys).select(*rows.columns), "pieces")
        drop_stored(rows, contexts, wanted)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    of_text = stored(out.groupBy("rid", "did").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    drop_stored(*spans)
    return of_text


def without_repeats(docs: DataFrame, length: int = 400, carry: bool = False, max_group: int = 512, bundle: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_text of every row of ``docs``.

    ``kept_text`` leaves out what a cut has left of a character; of a null
    text it is null, while ``kept`` is empty. With ``carry``, the rows' own
    columns but text come as the struct ``row``.
    """
    row = F.struct(*(docs[c] for c in docs.columns if c != "text"), F.lit(1).alias("_palimpsest_row")) if carry else F.struct(F.lit(1).alias("none"))
    base = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("did", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    of_text = repeated_spans(base.select("rid", "did", "text"), length, max_group, bundle)
    kinds = f"row {base.schema['row'].dataType.simpleString()}, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    out = base.join(of_text.hint("merge"), ["rid", "did"], "left").select("row", "doc_id", "text", "spans").mapInArrow(_removed(length), kinds)
    return out if carry else out.drop("row")


def keep_rest(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated strings cut out of text, and n_chars, if it is there, counted anew; a null text stays null."""
    found = without_repeats(docs, carry=True, **options)
    columns = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.char_length("kept_text").cast("long"), F.col("row").getField("n_chars").cast("long"))
    return found.select(*(columns[c].alias(c) if c in columns else F.col("row").getField(c).alias(c) for c in docs.columns))
