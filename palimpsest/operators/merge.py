"""Three-way merge of keyed snapshots.

Both sides are diffed against the base, and the diffs joined by key. A key
that one side alone changed takes that side's row. A key that both changed is
classified in this order: the same change; deleted against edited; added on
both sides; the model changed; otherwise the strategy of the model decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.diff import diff

CONFLICTS = {1: "both_changed", 2: "delete_edit", 3: "add_add", 4: "model_change"}


@dataclass(frozen=True)
class Strategy:
    """How a model merges rows that both sides changed.

    ``accumulates`` columns add both sides' differences to the base, even
    equal ones; ``cells``: other columns are merged each by itself, else a row
    that both sides changed differently is a conflict.
    """

    cells: bool = False
    accumulates: tuple[str, ...] = ()

    def merged(self, column: str) -> Column:
        b, o, t = F.col(f"b_{column}"), F.col(f"o_{column}"), F.col(f"t_{column}")
        if column in self.accumulates:
            return o + t - b
        return F.when(o.eqNullSafe(b), t).otherwise(o)

    def disagrees(self, columns: list[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            if c not in self.accumulates:
                b, o, t = F.col(f"b_{c}"), F.col(f"o_{c}"), F.col(f"t_{c}")
                out = out | (~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~o.eqNullSafe(t))
        return out if self.cells else out | ~self._one_side(columns)

    def _one_side(self, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            if c not in self.accumulates:
                out = out & F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}"))
        return out


@dataclass(frozen=True)
class Resolver(Strategy):
    """A strategy of the user's: ``decide`` gets a column's name and its base, ours and theirs, and returns value and conflict.

    It is asked for rows that both sides changed; a conflict in any column
    leaves the row as ours has it.
    """

    decide: Callable[[str, Column, Column, Column], tuple[Column, Column]] | None = None

    def _asked(self, column: str) -> tuple[Column, Column]:
        b, o, t = F.col(f"b_{column}"), F.col(f"o_{column}"), F.col(f"t_{column}")
        value, conflict = self.decide(column, b, o, t)
        both = ~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~o.eqNullSafe(t)
        return F.when(both, value).when(o.eqNullSafe(b), t).otherwise(o), both & F.coalesce(conflict, F.lit(False))

    def merged(self, column: str) -> Column:
        return self._asked(column)[0]

    def disagrees(self, columns: list[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | self._asked(c)[1]
        return out


def record_faults(conflicts: DataFrame, most: int = 10_000, location: int = 4096, reason: int = 1024) -> DataFrame:
    """Keys whose conflicts (key, location, reason) can't be recorded: too many, or a location or reason of too many bytes."""
    sizes = conflicts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("location")).cast("long").alias("location"), F.max(F.octet_length("reason")).cast("long").alias("reason"))
    return sizes.where((F.col("n") > most) | (F.col("location") > location) | (F.col("reason") > reason))


OPAQUE, PER_CELL = Strategy(), Strategy(cells=True)


def zipped(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that a side changed: o_kind and t_kind (null: unchanged) and values of base, ours and theirs."""
    side = lambda d, p: d.select("key", F.col("kind").alias(f"{p}_kind"), *(F.col(f"from_{v}").alias(f"{p}b_{v}") for v in values), *(F.col(f"to_{v}").alias(f"{p}_{v}") for v in values))
    z = side(diff(base, ours, key, values), "o").join(side(diff(base, theirs, key, values), "t"), "key", "full_outer")
    return z.select("key", "o_kind", "t_kind", *(F.coalesce(f"ob_{v}", f"tb_{v}").alias(f"b_{v}") for v in values), *(f"{p}_{v}" for v in values for p in ("o", "t")))


def classified(changed: DataFrame, values: list[str], model: str, strategy: Strategy) -> DataFrame:
    """``zipped`` rows with their class."""
    o, t = F.col("o_kind"), F.col("t_kind")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"o_{v}").eqNullSafe(F.col(f"t_{v}"))
    alike = same & (o == t)
    if strategy.accumulates:  # equal edits of an accumulating model still add up; equal additions are one
        alike = alike & (o != 3)
    models = ~F.col(f"o_{model}").eqNullSafe(F.col(f"t_{model}")) | ((o == 3) & ~F.col(f"o_{model}").eqNullSafe(F.col(f"b_{model}")))
    rest = [v for v in values if v != model]
    name = (
        F.when(t.isNull(), "ours")
        .when(o.isNull(), F.when(t == 1, "theirs_added").when(t == 2, "theirs_removed").otherwise("theirs_modified"))
        .when((o == 2) & (t == 2), "both_deleted")
        .when(alike, "convergent")
        .when((o == 2) | (t == 2), "delete_edit")
        .when(o == 1, "add_add")
        .when(models, "model_change")
        .when(strategy.disagrees(rest), "both_changed")
        .otherwise("combined")
    )
    return changed.withColumn("class", name)


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, values: list[str], model: str, strategy: Strategy, max_conflicts: int | None = 100_000) -> tuple[DataFrame, DataFrame]:
    """The merged snapshot, in which conflicts keep ours, and the conflicts.

    More than ``max_conflicts`` is an error, for callers that record or gather
    them; None: any number, as both results stay distributed.
    """
    rows = classified(zipped(base, ours, theirs, key, values), values, model, strategy)
    conflicts = rows.where(F.col("class").isin(*CONFLICTS.values()))
    if max_conflicts is not None and conflicts.limit(max_conflicts + 1).count() > max_conflicts:
        raise ValueError(f"more than {max_conflicts} conflicts")
    return merged_rows(ours, rows, key, values, strategy), conflicts


def merged_rows(ours: DataFrame, rows: DataFrame, key: str, values: list[str], strategy: Strategy) -> DataFrame:
    """Ours with theirs' own changes taken and combined rows merged."""
    moved = rows.where(F.col("class").startswith("theirs_") | (F.col("class") == "combined"))
    new = [F.when(F.col("class") == "combined", strategy.merged(v)).otherwise(F.col(f"t_{v}")).alias(v) for v in values]
    taken = moved.where("class <> 'theirs_removed'").select(F.col("key").alias(key), *new)
    return ours.join(moved.select(F.col("key").alias(key)), key, "left_anti").select(key, *values).unionByName(taken)


def merge_sets(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Elements that all three have, and those that either side added."""
    return base.intersect(ours).intersect(theirs).union(ours.exceptAll(base)).union(theirs.exceptAll(base)).distinct()


def stats(rows: DataFrame) -> DataFrame:
    """Applied changes of theirs by kind, merges by the model, and conflicts."""
    count = lambda *names: F.count_if(F.col("class").isin(*names))
    return rows.agg(count("theirs_added").alias("added"), count("theirs_removed").alias("removed"), count("theirs_modified", "combined").alias("modified"), count(*CONFLICTS.values()).alias("conflicts"))
