"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each document gives counts over its whole text, and the counts a vector of
``DIM`` transformed statistics. For each (lang, source), each language and all
documents, minimum covariance determinant estimates of centre and scatter are
made by concentration steps over all documents from three starts: distances
under the present estimate, the quantile of order ``support`` of the distances,
moments of the documents within it, until no determinant falls any more. A
source's estimate is blended with its language's, and that with the estimate
over all, by weights n² to ``held``²: what few documents say counts little, and
no size switches from one estimate to another. A document is rejected whose
squared Mahalanobis distance passes ``cutoff``. All sums, quantiles and moments
are Spark aggregates with map-side combining, so a group may hold any share of
the rows.

Null lang or source is a group like any other. A null or empty text has no
words and fails the base rules. Repeated rows are judged each, other columns
are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_stored, slices, stored

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
#: Each statistic, and the least standard deviation that it is given: below it, differences tell nothing.
STATS = (
    ("mean_word", lambda c: F.log((c("word_chars") + 25.0) / (c("n_words") + 5.0)), 0.10),
    ("symbols", lambda c: F.sqrt(c("n_symbols") / (c("n_words") + 20.0)), 0.05),
    ("dup_lines", lambda c: F.sqrt(c("n_dup_lines") / (c("n_lines") + 5.0)), 0.10),
    ("repeats", lambda c: F.sqrt(c("n_repeat_words") / (c("n_words") + 20.0)), 0.08),
    ("upper", lambda c: F.sqrt(c("n_upper") / (c("word_chars") + 50.0)), 0.05),
    ("marks", lambda c: F.sqrt((c("n_marks") + c("n_digits")) / (c("n_words") + 20.0)), 0.20),
)
#: The group of all documents; no language's name with the ending below is the same.
ALL = "\x1e"
DIM = len(STATS)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = 0
    if n >= 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0  # of the words counted so far
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeats += i + 5 - max(end, i)
                    end = i + 5
    upper = sum(map(str.isupper, words)) and sum(len(w) for w in words if w.isupper() and len(w) > 1)
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?-()[]{}\"'/@_=+"))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, upper, digits, marks, len(lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = [text_counts(t) for t in part.column("text").to_pylist()]
        columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "lang", "source")), *columns], ["row", "doc_id", "lang", "source", *COUNTS])


def with_statistics(docs: DataFrame, carry: bool) -> DataFrame:
    """doc_id, lang, source, counts and statistics x0.., of every row; ``row`` holds its columns if ``carry``."""
    row = F.struct(*(docs[c] for c in docs.columns)) if carry else F.struct(F.lit(1).alias("none"))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.mapInArrow(_count, kinds)
    counted = counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return counted.select("*", *(f(lambda c: F.col(c).cast("double")).alias(f"x{i}") for i, (_, f, _) in enumerate(STATS)))


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


def consistency(support: float) -> float:
    """What the scatter of the central ``support`` of a normal sample is to be multiplied by."""
    return support / chi2_cdf(chi2_quantile(support, DIM), DIM + 2)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under the joined centre m0.. and inverse scatter v0_0.."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"v{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return total


MOMENTS = [*(f"m{i}" for i in range(DIM)), *(f"s{i}_{j}" for i, j in PAIRS)]
#: A group's estimate: its rows, centre, scatter, inverse scatter with the least deviations added, and the log of the determinant.
ESTIMATE = "g string, start int, n long, " + ", ".join(f"{c} double" for c in (*MOMENTS, *(f"v{i}_{j}" for i, j in PAIRS))) + ", log_det double"


def _scatters(f: pd.DataFrame) -> np.ndarray:
    out = np.empty((len(f), DIM, DIM))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = f[f"s{i}_{j}"]
    return out


def _finished(f: pd.DataFrame, scatter: np.ndarray) -> pd.DataFrame:
    """Scatters, their inverses and determinants as columns of ``f``, which has g, start, n and centres."""
    out = f[["g", "start", "n", *(f"m{i}" for i in range(DIM))]].copy()
    firm = scatter + np.diag([s * s for _, _, s in STATS])
    inverse = np.linalg.inv(firm)
    for i, j in PAIRS:
        out[f"s{i}_{j}"], out[f"v{i}_{j}"] = scatter[:, i, j], inverse[:, i, j]
    out["log_det"] = np.linalg.slogdet(firm)[1] if len(f) else np.zeros(0)
    return out[[c.split()[0] for c in ESTIMATE.split(", ")]]


def _inverted(scale: float):
    """Moments (means, and means of products) of a group -> its estimate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            centre = f[[f"m{i}" for i in range(DIM)]].to_numpy()
            yield _finished(f, scale * (_scatters(f) - centre[:, :, None] * centre[:, None, :]))

    return run


def _blended(held: float):
    """Estimates joined with those above them (columns u_..): each weighs as n² against held²."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            up = f[[c for c in f if c.startswith("u_")]].rename(columns=lambda c: c[2:])
            weight = (f["n"].astype(float) ** 2 / (f["n"].astype(float) ** 2 + held**2)).to_numpy()
            scatter = weight[:, None, None] * _scatters(f) + (1 - weight)[:, None, None] * _scatters(up)
            for i in range(DIM):
                f[f"m{i}"] = weight * f[f"m{i}"] + (1 - weight) * up[f"m{i}"]
            yield _finished(f, scatter)

    return run


def _joined(rows: DataFrame, groups: DataFrame, max_groups: int, n_groups: int, salts: int = 64, key: str = "g") -> DataFrame:
    """Rows with their group's estimate: broadcast while there are few groups, else a join with salted keys."""
    if n_groups <= max_groups:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(DIM))), F.lit(salts)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _moments(of: DataFrame, *by: str) -> DataFrame:
    xs = [f"x{i}" for i in range(DIM)]
    return of.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)), *(F.avg(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i, j in PAIRS))


def _starts(rows: DataFrame, max_groups: int) -> DataFrame:
    """Three first estimates of each group: from medians and quartiles, from directions around the median, from all rows."""
    xs = [f"x{i}" for i in range(DIM)]
    middle = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(x) for x in xs))
    spread = lambda i: F.greatest((F.col(xs[i])[2] - F.col(xs[i])[0]) / 1.349, F.lit(STATS[i][2] / 10))
    middle = stored(middle.select("g", "n", *(F.col(x)[1].alias(f"c{i}") for i, x in enumerate(xs)), *(spread(i).alias(f"d{i}") for i in range(DIM))), "medians")
    centre = lambda i: F.col(f"c{i}").alias(f"m{i}")
    product = lambda i, j, scatter: (scatter + F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}")
    plain = middle.select("g", F.lit(0).alias("start"), "n", *map(centre, range(DIM)), *(product(i, j, F.col(f"d{i}") * F.col(f"d{j}") if i == j else F.lit(0.0)) for i, j in PAIRS))
    near = _joined(rows, middle.drop("n"), max_groups, middle.count())
    z = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}") for i in range(DIM)]
    norm = sum((x * x for x in z), F.lit(1e-12))
    signs = near.select("g", norm.alias("norm"), *(x.alias(f"z{i}") for i, x in enumerate(z))).groupBy("g").agg(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"q{i}_{j}") for i, j in PAIRS))
    turned = signs.join(middle, "g").select("g", F.lit(1).alias("start"), "n", *map(centre, range(DIM)), *(product(i, j, DIM * F.col(f"q{i}_{j}") * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in PAIRS))
    whole = _moments(rows, "g").withColumn("start", F.lit(2))
    return plain.unionByName(turned).unionByName(whole)


def estimates(rows: DataFrame, support: float, max_steps: int, max_groups: int) -> DataFrame:
    """The minimum covariance determinant estimate of each group g of the rows g, x0..

    Concentration steps from several starts, until no group's determinant
    falls by more than a thousandth; of each group the start that ends lowest.
    """
    groups = stored(_starts(rows, max_groups).mapInPandas(_inverted(1.0), ESTIMATE), "centres")
    n_groups = groups.count()
    scale = consistency(support)
    for _ in range(max_steps):
        inverse = groups.select("g", "start", *(f"m{i}" for i in range(DIM)), *(f"v{i}_{j}" for i, j in PAIRS))
        near = _joined(rows, inverse, max_groups, n_groups).select("g", "start", *(f"x{i}" for i in range(DIM)), _distance().alias("d2")).withColumn("gs", F.struct("g", "start"))
        limit = near.groupBy("gs").agg(F.percentile_approx("d2", F.lit(support), 5000).alias("limit"))
        core = _joined(near, limit, max_groups, n_groups, key="gs").where(F.col("d2") <= F.col("limit"))
        after = stored(_moments(core, "g", "start").mapInPandas(_inverted(scale), ESTIMATE), "centres")
        fall = groups.select("g", "start", F.col("log_det").alias("was")).join(after.select("g", "start", "log_det"), ["g", "start"]).agg(F.max(F.abs(F.col("was") - F.col("log_det")))).first()[0]
        drop_stored(groups)
        groups = after
        if (fall or 0.0) < 1e-3:
            break
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    least = groups.groupBy("g").agg(F.min_by(F.struct(*[c for c in groups.columns if c != "g"]), F.struct("log_det", "start")).alias("e")).select("g", "e.*")
    return least.join(sizes, "g").withColumn("n", F.col("size")).drop("size")


def quality(
    docs: DataFrame, carry: bool = False, support: float = 0.75, max_steps: int = 8, cutoff: float = 100.0, held: float = 50.0, max_groups: int = 20_000
) -> DataFrame:
    """Counts, base_failed, distance and kept of every row of ``docs``.

    ``cutoff`` is a squared distance; 100 lies far beyond the 1 - 1e-15
    quantile of a normal sample, so what is rejected is no tail of the clean.
    ``max_groups`` bounds what is broadcast: about 600 bytes for each group.
    ``carry``: the rows' own columns come too, as the struct ``row``.
    """
    rows = stored(with_statistics(docs, carry), "statistics")
    own = F.concat_ws("\x1f", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")))
    pool = F.concat_ws("\x1e", F.coalesce("lang", F.lit("\x00")), F.lit("all"))
    x = [f"x{i}" for i in range(DIM)]
    # A row counts for its group, for its language and for all.
    levels = F.explode(F.array(own, pool, F.lit(ALL))).alias("g")
    vectors = stored(rows.where(~F.col("base_failed")).select(levels, *x), "vectors")
    found = stored(estimates(vectors, support, max_steps, max_groups), "estimates")
    named = stored(rows.where(~F.col("base_failed")).select(own.alias("g"), pool.alias("pool")).distinct(), "groups")
    up = lambda df: df.select(*(F.col(c).alias(f"u_{c}") for c in df.columns))
    everything = up(found.where(F.col("g") == ALL))
    languages = found.where(F.col("g").endswith("\x1eall")).crossJoin(F.broadcast(everything)).mapInPandas(_blended(held), ESTIMATE)  # one row on the right
    languages = stored(languages, "languages")
    sources = found.join(named, "g").join(up(languages), F.col("pool") == F.col("u_g")).drop("pool")
    by_own = stored(sources.mapInPandas(_blended(held), ESTIMATE).drop("start", "n", "log_det", *(f"s{i}_{j}" for i, j in PAIRS)), "verdicts")
    n_named = by_own.count()
    drop_stored(vectors, found, named, languages)

    keyed = rows.withColumn("g", own)
    judged_rows = keyed.join(F.broadcast(by_own), "g", "left") if n_named <= max_groups else _left_salted(keyed, by_own)
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    keep = [c for c in rows.columns if c not in {*x, *([] if carry else ["row"])}]
    return judged_rows.withColumn("d2", _distance()).withColumn("kept", verdict).select(*keep, F.col("d2").alias("distance"), "kept")


def _left_salted(rows: DataFrame, groups: DataFrame, salts: int = 64) -> DataFrame:
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(salted, ["g", "salt"], "left").drop("salt")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns and no others."""
    return quality(docs, carry=True, **options).where("kept").select("row.*")
