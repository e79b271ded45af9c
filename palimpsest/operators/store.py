"""Chunks in packs: deduplication, placement, liveness and garbage collection planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.storage import stored


def has(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Each wanted hash with whether it is stored."""
    known = entries.select("hash").distinct().withColumn("stored", F.lit(True))
    return wanted.join(known, "hash", "left").select("hash", F.coalesce("stored", F.lit(False)).alias("stored"))


#: Packs that a join may broadcast; with more, entries are shuffled by pack.
MAX_BROADCAST = 1_000_000


def _few(packs: DataFrame, bound: int) -> DataFrame:
    """``packs``, stored so that they are made once; with a broadcast hint if there are at most ``bound``."""
    packs = stored(packs, "packs")
    return F.broadcast(packs) if packs.count() <= bound else packs


def new_chunks(incoming: DataFrame, entries: DataFrame, condemned: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The incoming hashes that no pack in service holds: chunks of condemned packs are written again.

    Up to ``max_broadcast`` condemned packs are broadcast; a hash that many
    packs hold is then one row a task before it is shuffled.
    """
    in_service = entries.join(_few(condemned.select("pack").distinct(), max_broadcast), "pack", "left_anti").select("hash").distinct()
    return incoming.select("hash").distinct().join(in_service, "hash", "left_anti")


def first_locations(entries: DataFrame, condemned: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The pack that answers for each hash: in service before condemned, then the first listed.

    Up to ``max_broadcast`` condemned packs are broadcast.
    """
    marked = entries.join(_few(condemned.select("pack").distinct().withColumn("out", F.lit(1)), max_broadcast), "pack", "left")
    place = F.struct(F.coalesce("out", F.lit(0)).alias("out"), "pack", "seq")
    return marked.groupBy("hash").agg(F.min(place).alias("p")).select("hash", "p.pack", "p.seq", (F.col("p.out") == 1).alias("condemned"))


def liveness(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Of each pack: chunks, bytes, live chunks and live bytes."""
    marked = entries.join(live.select("hash").distinct().withColumn("live", F.lit(1)), "hash", "left")
    is_live = F.col("live").isNotNull()
    return marked.groupBy("pack").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(is_live).alias("live_n"), F.coalesce(F.sum(F.when(is_live, F.col("bytes"))), F.lit(0).cast("long")).alias("live_bytes")
    )


def gc_states(packs: DataFrame, condemned: DataFrame, now: int, grace: int) -> DataFrame:
    """What a round does with each pack: keep, condemn, reprieve, wait or expire."""
    at = F.col("condemned_at")
    state = (
        F.when(at.isNull(), F.when(F.col("live_n") == 0, "condemn").otherwise("keep"))
        .when(F.col("live_n") > 0, "reprieve")
        .when(F.lit(now) - at >= grace, "expire")
        .otherwise("wait")
    )
    return packs.join(condemned.select("pack", "condemned_at"), "pack", "left").select("pack", "live_n", state.alias("state"))


def round_report(states: DataFrame, copied: DataFrame) -> DataFrame:
    """One row of what a collection does, from ``gc_states`` and the chunks (hash, bytes) that it copies."""
    count = lambda name: F.count_if(F.col("state") == name).alias(name)
    moved = copied.agg(F.count("*").alias("copied"), F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("copied_bytes"))
    return states.agg(F.count("*").alias("packs"), *map(count, ("keep", "condemn", "reprieve", "wait", "expire"))).crossJoin(moved)  # of one row each


def orphans(objects: DataFrame, named: DataFrame, recorded: DataFrame, now: int, grace: int) -> DataFrame:
    """Objects older than the grace period that no manifest names and whose deletion is not recorded yet."""
    old = objects.where(F.lit(now) - F.col("modified") >= grace)
    return old.join(named.select("name"), "name", "left_anti").join(recorded.select("name"), "name", "left_anti")


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in a total order, without one task for them all.

    Rows are dealt to partitions by ranges of the order; sums inside each are
    moved by the totals of those before, of which there is one a partition.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({f"_o{k}": c for k, c in enumerate(order)})
    keys = [f"_o{k}" for k in range(len(order))]
    dealt = stored(keyed.repartitionByRange(partitions, *keys).withColumn("_part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_part", "_base", "_total", *keys)


def repack(packs: DataFrame, budget: int, max_live: float = 0.5) -> DataFrame:
    """The packs to copy the live chunks of, emptiest first, while fewer bytes than ``budget`` are copied."""
    share = F.col("live_bytes") / F.col("bytes")
    candidates = packs.where((F.col("live_n") > 0) & (F.col("live_n") < F.col("n"))).where(share < max_live)
    return running_sum(candidates, [share, F.col("pack")], "live_bytes", "copied_before").where(F.col("copied_before") < budget)


def compaction_tiers(indexes: DataFrame) -> DataFrame:
    """Tiers, by powers of eight over a KiB of size, of index objects, and the lowest with eight or more."""
    tier = F.when(F.col("size") <= 1024, 0).otherwise(F.ceil(F.log(8.0, F.col("size") / 1024.0)).cast("int"))
    tiers = indexes.withColumn("tier", tier).groupBy("tier").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    ripe = tiers.where("n >= 8").agg(F.min("tier").alias("lowest"))
    return tiers.join(F.broadcast(ripe)).select("tier", "n", "size", F.coalesce(F.col("tier") == F.col("lowest"), F.lit(False)).alias("merge"))


def offsets(chunks: DataFrame) -> DataFrame:
    """Start and end of each chunk in its stream; a stream of any length is spread over tasks."""
    placed = running_sum(chunks, [F.col("stream"), F.col("seq")], "bytes", "_before")
    first = placed.groupBy("stream").agg(F.min("_before").alias("_first"))
    start = (F.col("_before") - F.col("_first")).cast("long")
    return placed.join(first.hint("merge"), "stream").select(*chunks.columns, start.alias("start"), (start + F.col("bytes")).alias("end"))


def read_at(chunks: DataFrame, reads: DataFrame) -> DataFrame:
    """For reads (stream, off, n): the chunks that they touch and which of their bytes."""
    found = offsets(chunks).join(reads, "stream").where("off < end and off + n > start")
    first = F.greatest("start", "off") - F.col("start")
    return found.select("stream", "off", "n", "seq", first.alias("from"), (F.least("end", F.col("off") + F.col("n")) - F.col("start") - first).alias("length"))


def chain_breaks(records: DataFrame) -> DataFrame:
    """Journal records whose expected root is not the one that the record before them made."""
    before = F.lag("next").over(Window.partitionBy("segment").orderBy("seq"))
    return records.withColumn("before", before).where("before is not null and before <> expected")


def rendezvous(names: DataFrame, volumes: DataFrame) -> DataFrame:
    """name, volume, score, rank: volumes of each name by descending score, the first eight bytes of a hash of volume and name.

    Over 64 volumes are refused, so a name's scores are sorted inside its row,
    and no task holds more than a row of them; a repeated name counts once for
    each of its rows.
    """
    found = [r[0] for r in volumes.select("volume").limit(65).collect()]
    if len(found) > 64:
        raise ValueError("at most 64 volumes")
    if not found:
        found, names = [None], names.limit(0)
    digits, inverse = "0123456789abcdef", "fedcba9876543210"  # what ascends inverted descends
    score = lambda volume: F.substring(F.sha2(F.concat_ws("\x1f", volume, "name"), 256), 1, 16)
    scored = F.array_sort(F.array(*(F.struct(F.translate(score(F.lit(v).cast("string")), digits, inverse).alias("inverted"), F.lit(v).cast("string").alias("volume")) for v in found)))
    # By another hash than the count, or its few tasks, as names are few bytes, would score them all.
    counted = names.groupBy("name").agg(F.count("*").alias("n")).repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))
    placed = counted.select("name", "n", F.posexplode(scored).alias("place", "one"))
    rank = F.col("place") * F.col("n") + F.col("copy")
    rows = placed.select("name", "place", "n", "one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return rows.select("name", F.col("one.volume").alias("volume"), F.translate("one.inverted", inverse, digits).alias("score"), rank.alias("rank"))


def mark(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes that the roots reach; only nodes that have been entered are passed over, never those merely named.

    What has been entered is one stored table after every eighth round, so
    plans and files stay few in long chains.
    """
    entered, parts = stored(roots.select("node").distinct(), "entered"), 1
    frontier = entered
    while True:
        named = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = stored(named.join(entered, "node", "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return entered
        entered, parts = entered.union(frontier), parts + 1
        if parts % 8 == 0:
            entered = stored(entered, "entered")


def allowed(changes: DataFrame, grants: DataFrame) -> DataFrame:
    """Each change (principal, action, path) with whether a grant (principal, action, prefix) covers it; none is a refusal."""
    fits = changes.join(grants, ["principal", "action"], "left").withColumn("fit", F.coalesce(F.col("path").startswith(F.col("prefix")), F.lit(False)))
    return fits.groupBy("principal", "action", "path").agg(F.bool_or("fit").alias("allowed"))
