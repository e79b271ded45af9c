"""MinHash near-duplicates with fast similarity sketches.

A sketch has ``coordinates`` bins. In round i every shingle is thrown into one
bin by a hash of (shingle, i), with the value (i, hash); the first rounds
throw freely, and round ``coordinates`` + j puts every shingle into bin j, so
every bin fills. A bin keeps its least value: what an earlier round put there
stays. Two sets agree in a bin with their Jaccard similarity as probability.

Texts with the same shingle set are one class from the start (grouped by a
hash of the set). Bands of the sketch give buckets. Shingle sets are made only
for classes that share a bucket. In each bucket every member is compared, on
full sets, with one pivot, the member that shares most: a star, linear in the
bucket. Links make components, and the bands are taken in ``steps``, so that
later bands only see buckets whose members are not yet all in one component.
What then remains, members outside a bucket's main component, is compared with
all of the bucket: as pairs where the bucket is small, else in blocks of
``block`` by ``block`` members that a task compares and of which it returns
links alone. Nothing is capped, and no group is gathered in one task.

A document without words has an empty set and is linked with nothing. A null
text is empty. Rows that repeat a doc_id are judged each; a null doc_id is
never a component's name while another id is there. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, drop_stored, few, slices, stored
from palimpsest.llm.textbytes import BASE, byte_values, find_words, lowered, mix, space_class, window_hashes, word_hashes

SHINGLE = 5
U = np.uint64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, concatenated, and n + 1 offsets."""
    words = find_words(column, space_class())
    hashes = word_hashes(words, lowered(byte_values(5)))
    counts = words.counts()
    values, at = window_hashes(hashes, words, SHINGLE)
    text = words.text[at]
    for size in range(1, SHINGLE):
        few = np.flatnonzero(counts == size)
        if len(few):
            total = hashes[words.first[few]].copy()
            for k in range(1, size):
                total = total * BASE + hashes[words.first[few] + k]
            values, text = np.r_[values, mix(total)], np.r_[text, few]
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(counts) + 1))


def sketches(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of ``coordinates`` values for each set; a set that is empty gets zeros."""
    sizes = np.diff(offsets)
    full = np.full((len(sizes), coordinates), 2**64 - 1, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    open_sets = sizes > 0
    for i in range(2 * coordinates):
        live = open_sets[owner]
        if not live.any():
            break
        if not live.all():
            values, owner = values[live], owner[live]
        thrown = mix(values + U(i + 1) * U(0xA0761D6478BD642F))
        where = (thrown >> U(40)) % U(coordinates) if i < coordinates else np.full(len(thrown), i - coordinates, np.uint64)
        value = (U(i) << U(54)) | (mix(thrown) >> U(10))
        np.minimum.at(full.reshape(-1), owner * coordinates + where.astype(np.int64), value)
        seen = np.unique(owner)
        open_sets[seen] = (full[seen] == U(2**64 - 1)).any(axis=1)
    full[sizes == 0] = 0
    return full


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    rows = sketch.shape[1] // bands
    keys = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(sketch), b + 1, np.uint64)
        for r in range(rows):
            total = mix(total * BASE + sketch[:, b * rows + r])
        keys[:, b] = total
    return keys


DIGESTS = "doc_id long, row_key long, n_shingles long, h1 long, h2 long, keys array<long>"
SETS = "h1 long, h2 long, n long, shingles binary"
NONE = (None, None)


def _digest(shingles: bytes) -> tuple[int, int] | tuple[None, None]:
    return struct.unpack("<qq", hashlib.blake2b(shingles, digest_size=16).digest()) if shingles else NONE


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    values, offsets = shingle_sets(column)
    data = values.tobytes()
    return values, offsets, [data[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digests(coordinates: int, bands: int):
    """Of each text: the size and name of its shingle set and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4_000_000):
            values, offsets, sets = _split(part.column("text"))
            keys = band_keys(sketches(values, offsets, coordinates), bands)
            names = [_digest(x) for x in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "row_key": part.column("row_key"),
                    "n_shingles": pa.array(np.diff(offsets), pa.int64()),
                    "h1": pa.array([a for a, _ in names], pa.int64()),
                    "h2": pa.array([b for _, b in names], pa.int64()),
                    "keys": pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                }
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4_000_000):
        _, offsets, sets = _split(part.column("text"))
        names = [_digest(x) for x in sets]
        yield pa.RecordBatch.from_pydict(
            {"h1": pa.array([a for a, _ in names], pa.int64()), "h2": pa.array([b for _, b in names], pa.int64()), "n": pa.array(np.diff(offsets), pa.int64()), "shingles": pa.array(sets, pa.binary())}
        )


def _compare(percent: int):
    """Whether the sets of each pair are as alike as ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "sa", 16_000_000):
            common = []
            for a, b in zip(part.column("sa"), part.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common.append(int((large[at] == small).sum()))
            both = np.array(common, np.int64)
            union = part.column("na").to_numpy() + part.column("nb").to_numpy() - both
            yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "linked": pa.array(100 * both >= percent * union)})

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of distinct pairs of nodes, on their full shingle sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sizes = (percent * F.col("na") <= 100 * F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na"))
    return pairs.join(left, "a").join(right, "b").where(sizes).mapInArrow(_compare(percent), "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for all nodes of the undirected edges a, b.

    Each round every node takes the least root among its own, its neighbours'
    and what its root's other members found (minima with map-side combining),
    then the root's root: paths halve, so rounds grow with a chain's logarithm.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.select("node", "root").join(near, "node", "left")
        hooks = step.where("near < root").groupBy("root").agg(F.min("near").alias("hook"))
        step = step.join(hooks, "root", "left").select("node", F.col("root").alias("old"), F.least("root", "near", "hook").alias("root"))
        jumps = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = stored(step.join(jumps, "root", "left").select("node", "old", F.least("root", "up").alias("root")), "roots")
        drop_stored(roots)
        done = not after.where("old <> root").limit(1).count()
        roots = after
        if done:
            drop_stored(both)
            return roots


def _open(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one component, with root and the bucket's size."""
    if roots is None:
        members = shared.withColumn("root", F.col("node"))
    else:
        members = shared.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = members.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return members.join(mixed.select("key", "size"), "key")


def _star(members: DataFrame) -> DataFrame:
    """Each member of another component than its bucket's pivot, with that pivot, as pairs a, b."""
    scores = members.groupBy("node").agg(F.sum("size").alias("score"))
    pivots = members.join(scores, "node").groupBy("key").agg(F.max(F.struct("score", "node", "root")).alias("p"))
    pairs = members.join(pivots, "key").where("root <> p.root")
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _small_rest(members: DataFrame, small: int) -> DataFrame:
    """All pairs of different components in the buckets of at most ``small`` members."""
    some = members.where(F.col("size") <= small)
    x = some.select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
    y = some.select("key", F.col("node").alias("b"), F.col("root").alias("rb"))
    return x.join(y, "key").where("a < b and ra <> rb").select("a", "b").distinct()


def _block_links(percent: int, bands: int):
    """Links in one block of a bucket: of members outside its main component with members of others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rest = table.column("rest").to_numpy(zero_copy_only=False).astype(bool)
        node, root, n, key = (table.column(c).to_numpy() for c in ("node", "root", "n", "key"))
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(node), bands)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        others = np.flatnonzero(~rest)
        out: list[tuple[int, int]] = []
        if len(others):
            values = np.concatenate([sets[i] for i in others])
            begins = np.cumsum([0, *(len(sets[i]) for i in others[:-1])])
            for s in np.flatnonzero(rest):
                # A pair is compared in the first bucket that it shares.
                first = keys[s][np.argmax(keys[others] == keys[s], axis=1)] == key[0]
                free = first & (root[others] != root[s]) & (percent * n[others] <= 100 * n[s]) & (percent * n[s] <= 100 * n[others])
                if free.any():
                    own = sets[s]
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    both = np.add.reduceat((own[at] == values).astype(np.int64), begins)
                    for i in np.flatnonzero(free & (100 * both >= percent * (n[others] + n[s] - both))):
                        out.append((int(node[s]), int(node[others[i]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _large_rest(members: DataFrame, sets: DataFrame, keyed: DataFrame, percent: int, bands: int, small: int, block: int) -> DataFrame:
    """Links of the members outside the main component of buckets of over ``small`` members."""
    large = members.where(F.col("size") > small)
    by_root = large.groupBy("key", "root").agg(F.count("*").alias("m"))
    main = by_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("all"))
    large = large.join(main, "key").withColumn("rest", F.col("root") != F.col("main.root"))
    blocks_all = F.ceil(F.col("all") / block).cast("int")
    blocks_rest = F.ceil((F.col("all") - F.col("main.m")) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = ["key", "node", "root"]
    queries = large.where("rest").select(*base, F.lit(True).alias("rest"), own(blocks_rest).alias("j"), every(blocks_all).alias("i"))
    against = large.select(*base, F.lit(False).alias("rest"), own(blocks_all).alias("i"), every(blocks_rest).alias("j"))
    both = queries.unionByName(against).join(sets, "node").join(keyed.select("node", "keys"), "node")
    return both.groupBy("key", "i", "j").applyInArrow(_block_links(percent, bands), "a long, b long").distinct()


def verdicts(docs: DataFrame, percent: int, coordinates: int, bands: int, steps: tuple[int, ...], small: int, block: int, max_broadcast: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and first (whether the row has its component's least doc_id and key), stored.

    ``row_key`` is a hash of doc_id and text. A row without shingles is a
    component by itself. What is stored on the way is deleted.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        made.append(stored(df, what))
        return made[-1]

    texts = documents(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = keep(texts.mapInArrow(_digests(coordinates, bands), DIGESTS), "digests")
    by_set = rows.where("h1 is not null").groupBy("h1", "h2")
    first_row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    classes = by_set.agg(F.min(first_row).alias("least"), F.min_by("keys", "n_shingles").alias("keys"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", "keys")

    members = keyed.select("node", F.posexplode("keys").alias("band", "key"))
    often = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = keep(members.join(often.hint("merge"), "key").select("node", "band", "key"), "shared")
    wanted = keep(shared.select("node").distinct().join(classes.select("node", "h1", "h2", "least"), "node"), "wanted")
    sets = texts.join(few(wanted.select("least.row_key").distinct(), max_broadcast), "row_key", "left_semi").mapInArrow(_sets, SETS)
    sets = sets.join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "n", "shingles").dropDuplicates(["node"])
    sets = keep(sets, "sets")

    roots, links, seen, taken = None, None, None, 0
    for upto in steps:
        open_members = stored(_open(shared.where((F.col("band") >= taken) & (F.col("band") < upto)), roots), "open")
        pairs = _star(open_members)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        found = keep(verified(pairs, sets, percent), "verified")
        drop_stored(open_members, roots)
        links = found.where("linked").select("a", "b") if links is None else links.union(found.where("linked").select("a", "b"))
        seen = found.select("a", "b") if seen is None else seen.union(found.select("a", "b"))
        roots, taken = components(links), upto
    open_members = keep(_open(shared, roots), "open")
    few_left = verified(_small_rest(open_members, small).join(seen, ["a", "b"], "left_anti"), sets, percent).where("linked").select("a", "b")
    many_left = _large_rest(open_members, sets, keyed, percent, bands, small, block)
    last = keep(few_left.union(many_left), "links")
    if last.limit(1).count():
        drop_stored(roots)
        roots = components(links.union(last))
    made.append(roots)

    labels = keep(classes.select("node", "h1", "h2", "least").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "labels")
    names = labels.groupBy("root").agg(F.min("least").alias("name"))
    of_class = labels.select("h1", "h2", "root").join(names, "root").select("h1", "h2", "name")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    found = rows.select("doc_id", "row_key", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left").withColumn("name", F.coalesce("name", own))
    component_id = F.coalesce("name.doc_id", "doc_id")
    first = F.col("row_key") == F.col("name.row_key")
    out = stored(found.select("doc_id", "row_key", "n_shingles", component_id.alias("component_id"), first.alias("first")), "verdicts")
    drop_stored(*made)
    return out


def near_duplicates(
    docs: DataFrame, percent: int = 75, coordinates: int = 128, bands: int = 32, steps: tuple[int, ...] = (8, 32), small: int = 48, block: int = 400, max_broadcast: int = 500_000
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union. A pair
    of similarity 0.75 shares none of 32 bands of 4 with probability 6e-6.
    ``max_broadcast`` bounds the keys that are broadcast to select texts.
    """
    found = verdicts(docs, percent, coordinates, bands, steps, small, block, max_broadcast)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_each(
    docs: DataFrame, percent: int = 75, coordinates: int = 128, bands: int = 32, steps: tuple[int, ...] = (8, 32), small: int = 48, block: int = 400, max_broadcast: int = 500_000
) -> DataFrame:
    """One row of each component of ``docs``, with its columns and no others.

    It is the row of the least doc_id (null after all others) and, of rows
    that repeat it, of the least hash of its text; of rows that are equal in
    both, that of the least hash over all columns. Rows without words stay, but
    for those that repeat a doc_id and its text.
    """
    found = verdicts(docs, percent, coordinates, bands, steps, small, block, max_broadcast)
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    gone = found.where("not first").select(F.col("row_key").alias("_palimpsest_key")).distinct()
    left = docs.join(few(gone, max_broadcast), key == F.col("_palimpsest_key"), "left_anti")
    times = found.where("first and (n_shingles > 0 or doc_id is not null)").groupBy("row_key").count().where("count > 1")
    repeated = stored(times.select(F.col("row_key").alias("_palimpsest_key")), "repeated")
    if not repeated.limit(1).count():
        return left
    again = left.join(few(repeated, max_broadcast), key == F.col("_palimpsest_key"))
    one = again.groupBy("_palimpsest_key").agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.xxhash64(*docs.columns)).alias("_palimpsest_row"))
    return left.join(few(repeated, max_broadcast), key == F.col("_palimpsest_key"), "left_anti").unionByName(one.select("_palimpsest_row.*"))
