"""Quality classifier from weak labels.

Heuristic labellers vote on each document: bad, good or nothing. The numbers
of documents with each pattern of votes, at most 3 ** labellers of them, are
counted over all documents, and expectation-maximisation on them estimates how
often bad documents are and how often each labeller gives each vote to bad and
to good ones. The posterior of a document's pattern is its label. A hashed
linear scorer (logistic regression) is trained on a bounded sample with these
labels, and scores every document over its whole text. There are two such
tasks, ``quality`` and ``toxic``.

A null or empty text has no words; its labellers vote as its counts say.
Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, slices, stored
from palimpsest.llm.quality import COUNTS, text_counts
from palimpsest.llm.textbytes import Words, byte_values, find_words, lowered, mix, space_class, word_hashes

LETTERS = re.compile(r"[^\W\d_]+")
# Fixed word lists: common English insults, and the commonest English words.
PERSONS = frozenset("idiot idiots moron morons loser losers clown clowns scum fool fools imbecile bastard jerk".split())
QUALITIES = frozenset("stupid pathetic disgusting worthless useless hateful".split())
THINGS = frozenset("trash garbage filth rubbish crap vermin".split())
ENGLISH = frozenset("the of and to in that is was for it with as be this are from".split())
BAD, GOOD, NONE = 1, 0, 2
DIMENSIONS = 1 << 15
LENGTHS = (4, 5, 6, 7, 8)


def _vote(value: float, bad: float, good: float) -> int:
    """Bad at ``bad`` or beyond, good at ``good`` or below it."""
    return BAD if value >= bad else GOOD if value <= good else NONE


def quality_votes(c: dict[str, int], distinct: int, marked: int) -> list[int]:
    """Eight labellers; each way of being bad shows in two of them or more. ``marked``: words with a symbol in them."""
    n = max(1, c["n_words"])
    return [
        _vote(c["n_symbols"] / n, 0.15, 0.03),
        _vote(marked / n, 0.15, 0.03),
        _vote(c["n_repeat_words"] / n, 0.20, 0.05),
        _vote(-distinct / n, -0.55, -0.70) if 10 <= n < 200 else _vote(-distinct / n, -0.20, -0.35),
        _vote(c["n_upper"] / max(1, c["word_chars"]), 0.30, 0.10),
        _vote(c["n_marks"] / n, 0.80, 0.40),
        _vote(c["n_dup_lines"] / max(1, c["n_lines"]), 0.30, 0.10),
        _vote(abs(np.log(max(1, c["word_chars"]) / n / 5.5)), 0.5, 0.3),
    ]


Beginnings = tuple[frozenset[str], frozenset[str]]
UNLEARNED: Beginnings = (frozenset(), frozenset())


def toxic_votes(words: list[str], learned: Beginnings = UNLEARNED) -> list[int]:
    """Five labellers: three word lists, and beginnings learned from each half of the given labels."""
    counts = Counter(words)
    persons, qualities, things, english = (sum(map(counts.__getitem__, own)) for own in (PERSONS, QUALITIES, THINGS, ENGLISH))
    # English lists tell nothing of a text in another language that has none of their words.
    clean = GOOD if 25 * english >= len(words) else NONE
    votes = [BAD if n else clean for n in (persons, qualities, things)]
    heads = heads_of(learned)
    told = [w for w in counts if w[:4] in heads]
    return votes + [NONE if not own else BAD if any(w[:k] in own for w in told for k in LENGTHS) else GOOD for own in learned]


@lru_cache(maxsize=4)
def heads_of(learned: Beginnings) -> frozenset[str]:
    return frozenset(b[:4] for own in learned for b in own)


TASKS = {"quality": 8, "toxic": 5}
MARKED = re.compile("[^\\x20\\x09-\\x0d]*[#*$%&|<>][^\\x20\\x09-\\x0d]*")
VOTES = "doc_id long, tie long, quality int, toxic int, " + ", ".join(f"{c} long" for c in COUNTS) + ", distinct long"


def _pattern(votes: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def telling_beginnings(docs: DataFrame, labels: DataFrame, sample: int = 4000, most: int = 400) -> Beginnings:
    """Beginnings of words, of ``LENGTHS`` letters, that documents labelled toxic have and others don't, from each half of the labels.

    From at most ``sample`` labelled documents, those of the least hashes,
    dealt to halves by another hash; at most ``most`` beginnings of each half,
    the commonest first.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    told = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = documents(docs).join(F.broadcast(told), "doc_id").select("bad", half, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"), "doc_id")
    begun = words.where(F.char_length("word") >= 4).select("doc_id", "half", "bad", F.explode(F.array(*(F.substring("word", 1, k) for k in LENGTHS))).alias("start")).distinct()
    counts = begun.groupBy("half", "start").agg(F.count_if("bad").alias("yes"), F.count_if(~F.col("bad")).alias("no")).where("yes >= 5 and yes >= 15 * no")
    found = [counts.where(F.col("half") == k).orderBy(F.desc("yes"), "start").limit(most).collect() for k in (0, 1)]
    return tuple(frozenset(r["start"] for r in own) for own in found)


def _votes(batches: Iterator[pa.RecordBatch], learned: Beginnings = UNLEARNED) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4_000_000):
        quality, toxic, counts = [], [], []
        for text in part.column("text").to_pylist():
            own = text_counts(text)
            distinct = len(set((text or "").split()))
            named = dict(zip(COUNTS, own, strict=True))
            marked = len(MARKED.findall(text)) if named["n_symbols"] else 0
            quality.append(_pattern(quality_votes(named, distinct, marked)))
            toxic.append(_pattern(toxic_votes(LETTERS.findall((text or "").lower()), learned)))
            counts.append((*own, distinct))
        columns = {c: pa.array([x[k] for x in counts], pa.int64()) for k, c in enumerate((*COUNTS, "distinct"))}
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "tie": part.column("tie"), "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32())} | columns)


class WeakLabels:
    """Dawid and Skene's model of labellers with votes bad, good and none, fitted to counts of patterns.

    Of the documents and of every labeller three things are estimated by
    expectation-maximisation until they stay: how many are bad, how often a
    vote on a bad document calls it bad, and how often one on a good document
    does; a labeller's silence tells nothing. The two rates have weak priors,
    which ``held`` documents' worth of votes outweigh: half of the bad are
    found, and one of fifty good ones called bad.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 1000, held: float = 20.0):
        self.labellers = labellers
        votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
        weight = counts.astype(float)
        calls = (votes == BAD).sum(axis=1)
        posterior = np.where(calls > 1, 0.95, np.where(calls == 1, 0.5, 0.01))
        self.prior, self.table = 0.0, np.zeros((labellers, 2, 2))
        called, given = (votes == BAD).astype(float), (votes != NONE).astype(float)
        for _ in range(rounds):
            before = self.prior, self.table
            self.prior = float(np.clip((weight * posterior).sum() / max(weight.sum(), 1), 1e-6, 0.5))
            bad = ((weight * posterior) @ called + 0.5 * held) / ((weight * posterior) @ given + held)
            good = ((weight * (1 - posterior)) @ called + 0.02 * held) / ((weight * (1 - posterior)) @ given + held)
            self.table = np.stack([np.stack([1 - good, good], axis=1), np.stack([1 - bad, bad], axis=1)], axis=1)
            posterior = self._posterior(votes)
            if abs(self.prior - before[0]) + np.abs(self.table - before[1]).max() < 1e-9:
                break

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k in range(self.labellers):
            odds += np.append(np.log(self.table[k, 1] / self.table[k, 0]), 0.0)[votes[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(patterns[:, None] // 3 ** np.arange(self.labellers) % 3)

    def accuracies(self) -> np.ndarray:
        """Of each labeller: the share of right votes among those it gives."""
        right = self.prior * self.table[:, 1, BAD] + (1 - self.prior) * self.table[:, 0, GOOD]
        return right / (right + self.prior * self.table[:, 1, GOOD] + (1 - self.prior) * self.table[:, 0, BAD])


def features(texts: pa.Array, counts: np.ndarray, patterns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and value: words, their beginnings and ends as shares of the text, ranges of its statistics, and the labellers' votes."""
    words = find_words(texts, space_class())
    share = 1 / np.maximum(words.counts(), 1)
    low, raw = lowered(byte_values(21)), byte_values(22)
    size = words.end - words.start
    kinds = [
        word_hashes(words, low),
        word_hashes(Words(words.data, words.start, words.start + np.minimum(size, 5), words.text, words.first), low),
        word_hashes(Words(words.data, words.start, words.start + np.minimum(size, 2), words.text, words.first), raw),
        word_hashes(Words(words.data, words.end - np.minimum(size, 2), words.end, words.text, words.first), raw),
    ]
    n = np.maximum(counts[:, 0:1], 1)
    ranges = np.floor(8 * np.sqrt(np.minimum(counts[:, 1:] / n, 16))).astype(np.uint64)
    ranges = np.concatenate([ranges, np.floor(np.log2(n)).astype(np.uint64)], axis=1)
    rows, columns, values = [], [], []
    for k, h in enumerate(kinds):
        rows.append(words.text)
        columns.append(mix(h + np.uint64(k)) & np.uint64(DIMENSIONS - 1))
        values.append(8 * share[words.text])
    for k in range(ranges.shape[1]):
        rows.append(np.arange(len(n)))
        columns.append(mix(ranges[:, k] + np.uint64(1000 * (k + 1))) & np.uint64(DIMENSIONS - 1))
        values.append(np.ones(len(n)))
    for t, (task, labellers) in enumerate(TASKS.items()):
        votes = patterns[task][:, None] // 3 ** np.arange(labellers) % 3
        row, k = np.nonzero(votes != NONE)
        rows.append(row)
        columns.append(mix((votes[row, k] + 2 * k + 100 * t).astype(np.uint64) + np.uint64(10**9)) & np.uint64(DIMENSIONS - 1))
        values.append(np.ones(len(row)))
    return np.concatenate(rows), np.concatenate(columns).astype(np.int64), np.concatenate(values)


def _patterns(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {task: part.column(task).to_numpy().astype(np.int64) for task in TASKS}


STATISTICS = [*COUNTS, "distinct"]


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(c).to_numpy() for c in STATISTICS], axis=1).astype(float)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 2_000_000):
        rows, columns, values = features(part.column("text"), _matrix(part), _patterns(part))
        key = rows * DIMENSIONS + columns
        seen, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, values)
        cuts = np.searchsorted(seen // DIMENSIONS, np.arange(part.num_rows + 1))
        lists = [(seen[a:b] % DIMENSIONS, total[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"tie": part.column("tie"), "quality": part.column("quality"), "toxic": part.column("toxic")}
            | {"columns": pa.array([c for c, _ in lists], pa.list_(pa.int32())), "values": pa.array([v for _, v in lists], pa.list_(pa.float32()))}
        )


def train(columns: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 80, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse rows, by gradient steps of adapted size."""
    row = np.repeat(np.arange(len(labels)), np.diff(offsets))
    w, b = np.zeros(DIMENSIONS), 0.0
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        score = np.bincount(row, values * w[columns], minlength=len(labels)) + b
        error = weights * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) / weights.sum()
        gradient = np.append(np.bincount(columns, values * error[row], minlength=DIMENSIONS) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4_000_000):
            rows, columns, values = features(part.column("text"), _matrix(part), _patterns(part))
            out = {"doc_id": part.column("doc_id")}
            for task, (label, w, b) in models.value.items():
                score = np.bincount(rows, values * w[columns], minlength=part.num_rows) + b
                out[f"{task}_posterior"] = pa.array(label.posterior(part.column(task).to_numpy().astype(np.int64)))
                out[f"{task}_score"] = pa.array(1 / (1 + np.exp(-np.clip(score, -30, 30))))
            yield pa.RecordBatch.from_pydict(out)

    return run


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = 1500, threshold: float = 0.85, toxic_threshold: float = 0.5) -> DataFrame:
    """doc_id, and for each task the posterior of its labellers and the scorer's probability; low_quality, toxic, kept.

    The scorer learns from at most ``sample`` documents with a posterior of at
    least one half and as many with a lower one, per task, those of the least
    hashes, rows that repeat doc_id and text once; everything else covers all
    rows. ``labels`` (doc_id, toxic) give two labellers more: see
    ``telling_beginnings``.
    """
    learned = telling_beginnings(docs, labels) if labels is not None else UNLEARNED
    votes_and_text = partial(_votes_with_text, learned=learned)
    rows = documents(docs).withColumn("tie", F.xxhash64("doc_id", "text"))
    spark = docs.sparkSession
    voted_text = stored(rows.mapInArrow(votes_and_text, VOTES + ", text string"), "votes")  # votes are cast once
    votes = voted_text.drop("text")
    models = {}
    for task, labellers in TASKS.items():
        counts = votes.groupBy(task).agg(F.count("*").alias("n")).toPandas()  # at most 3 ** labellers rows
        label = WeakLabels(counts[task].to_numpy(np.int64), counts["n"].to_numpy(), labellers)
        patterns = counts[task].to_numpy(np.int64)
        bad = [int(p) for p, q in zip(patterns, label.posterior(patterns), strict=True) if q >= 0.5]
        is_bad = F.col(task).isin(bad) if bad else F.lit(False)
        picked = [votes.where(side).select("tie").distinct().orderBy("tie").limit(sample) for side in (is_bad, ~is_bad)]
        chosen = F.broadcast(picked[0].union(picked[1]))  # at most twice ``sample`` rows
        texts = voted_text.join(chosen, "tie", "left_semi").select(*voted_text.columns).dropDuplicates(["tie"])  # rows that repeat are one
        own = texts.mapInArrow(_sample_features, "tie long, quality int, toxic int, columns array<int>, values array<float>").toArrow().sort_by("tie")
        if not own.num_rows:
            models[task] = (label, np.zeros(DIMENSIONS), -30.0)
            continue
        target = label.posterior(own.column(task).to_numpy().astype(np.int64))
        share = max(target.mean(), 1e-6)
        balance = np.where(target >= 0.5, label.prior / share, (1 - label.prior) / max(1 - share, 1e-6))
        # Half way to the true shares: bad documents are few, and should be learned.
        columns, values = (own.column(c).combine_chunks() for c in ("columns", "values"))
        offsets = np.cumsum([0, *columns.value_lengths().to_pylist()])
        w, b = train(columns.flatten().to_numpy(), values.flatten().to_numpy(), offsets, target, np.sqrt(balance))
        models[task] = (label, w, b)
    found = voted_text.mapInArrow(_score(spark.sparkContext.broadcast(models)), "doc_id long, quality_posterior double, quality_score double, toxic_posterior double, toxic_score double")
    return (
        found.withColumn("low_quality", F.col("quality_score") >= threshold)
        .withColumn("toxic", F.col("toxic_score") >= toxic_threshold)
        .withColumn("kept", ~F.col("low_quality") & ~F.col("toxic"))
    )


def _votes_with_text(batches: Iterator[pa.RecordBatch], learned: Beginnings = UNLEARNED) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4_000_000):
        for voted in _votes(iter([part]), learned):
            yield pa.RecordBatch.from_arrays([*voted.columns, part.column("text")], [*voted.schema.names, "text"])
