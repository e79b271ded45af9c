"""Questions about the graph of commits (id, parents, height).

A frontier is joined with the commits once a generation; what has been reached
is kept in the shared checkpoint folder, so plans stay short in long
histories. Parents are lower than their children, which bounds the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.storage import drop_folder, drop_stored, shared_dir, stored, stored_parts


def closure(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """start, id, height of every commit that each start (start, id) reaches, itself included.

    A round takes the highest commits that wait and adds their parents to
    those that wait. All that reaches a commit is higher, so a height is whole
    when its turn comes and is not compared with what has been reached: a
    round reads only its own height's pairs and edges. Were a parent no lower
    than its child, its height would come again, for the pairs that it had not.
    """
    spark = commits.sparkSession
    levels = commits.groupBy("id").agg(F.coalesce(F.max("height"), F.lit(0)).alias("level"))
    above = levels.select(F.col("id").alias("parent"), F.col("level").alias("next"))
    edges_dir, root = shared_dir(spark, "edges"), shared_dir(spark, "reached")
    of_level = stored_parts(commits.select("id", F.explode("parents").alias("parent")).where("id <> parent").join(levels, "id").join(above, "parent").select("level", "id", "parent", "next"), edges_dir, "level")
    first = starts.join(levels, "id").select("start", "id", "level")
    pair, edge = first.select("start", "id").schema, spark.read.parquet(edges_dir).select("id", "parent", "next").schema if of_level else None
    new = {level: [path] for level, path in stored_parts(first, f"{root}/round=0", "level").items()}
    old: dict[int, list[str]] = {}
    rounds = 0
    while new:
        level = max(new)
        paths = new.pop(level)
        if level in of_level:
            fresh = spark.read.schema(pair).parquet(*paths)
            if level in old:
                fresh = fresh.join(spark.read.schema(pair).parquet(*old[level]), ["start", "id"], "left_anti")
            rounds += 1
            further = fresh.distinct().join(spark.read.schema(edge).parquet(of_level[level]), "id").select("start", F.col("parent").alias("id"), F.col("next").alias("level"))
            for at, path in stored_parts(further, f"{root}/round={rounds}", "level").items():
                new.setdefault(at, []).append(path)
        old.setdefault(level, []).extend(paths)
    drop_folder(spark, edges_dir)
    reached = spark.read.schema(pair).parquet(root).select("start", "id").distinct()
    return reached.join(commits.select("id", "height"), "id").select("start", "id", "height")


def log(reached: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` commits of each start: highest first, then by id; with their place."""
    if not 1 <= limit <= 10_000:
        raise ValueError("a log has 1 to 10,000 commits")
    by = Window.partitionBy("start").orderBy(F.desc("height"), "id")
    return reached.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= limit)


def merge_bases(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of starts: the highest commit that both reach, the least id of equals."""
    a = reached.select(F.col("start").alias("a"), "id", "height")
    b = reached.select(F.col("start").alias("b"), "id")
    common = pairs.join(a, "a").join(b, ["b", "id"])
    best = common.groupBy("a", "b").agg(F.max("height").alias("height"))
    return common.join(best, ["a", "b", "height"]).groupBy("a", "b", "height").agg(F.min("id").alias("base"))


def _edges(commits: DataFrame) -> DataFrame:
    """id, parent, height (the parent's), stored."""
    heights = commits.select(F.col("id").alias("parent"), "height")
    return stored(commits.select("id", F.explode("parents").alias("parent")).join(heights, "parent").select("id", "parent", "height"), "edges")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def logs(commits: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """start, id, height, place of the first ``limit`` commits that each start (start, id) reaches: highest first, then by id.

    A commit among the first has its children among them, so each round goes
    on only from those that are: no more than ``limit`` are held for a start.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("a log has 1 to 10,000 commits")
    edges = _edges(commits)
    by = Window.partitionBy("start").orderBy(F.desc("height"), "id")
    found = stored(starts.join(commits.select("id", "height"), "id").select("start", "id", "height").distinct().withColumns({"fresh": F.lit(True), "place": F.lit(1).cast("long")}), "log")
    while True:
        further = found.where("fresh").join(edges.withColumnRenamed("height", "parent_height"), "id").select("start", F.col("parent").alias("id"), F.col("parent_height").alias("height"), F.lit(True).alias("fresh"))
        all_of = found.select("start", "id", "height", F.lit(False).alias("fresh")).unionByName(further).groupBy("start", "id", "height").agg(F.bool_and("fresh").alias("fresh"))
        after = stored(all_of.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= limit), "log")
        drop_stored(found)
        found = after
        if not found.where("fresh").limit(1).count():
            drop_stored(edges)
            return found.select("start", "id", "height", "place")


def nearest_bases(commits: DataFrame, starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, height, base: of pairs (a, b) of starts (start, id), the highest commit that both reach, the least id of equals.

    Both frontiers go down together, the highest commits of each pair first,
    so its first commit with both marks is the base, and nothing below it is
    read. Pairs without a common commit have no row.
    """
    edges = _edges(commits)
    heads = starts.join(commits.select("id", "height"), "id").select("start", "id", "height")
    side = lambda name, mark: pairs.join(heads.withColumnRenamed("start", name), name).select("a", "b", "id", "height", F.lit(mark).alias("marks"))
    frontier = side("a", 1).unionByName(side("b", 2))
    pair = Window.partitionBy("a", "b")
    settled: list[DataFrame] = []
    while True:
        merged = frontier.groupBy("a", "b", "id", "height").agg(F.bit_or("marks").alias("marks"))
        top = merged.withColumn("top", F.max("height").over(pair)).withColumn("met", F.max((F.col("marks") == 3) & (F.col("height") == F.col("top"))).over(pair))
        now = stored(top, "frontier")
        if not now.limit(1).count():
            drop_stored(edges)
            break
        settled.append(now.where("met and marks = 3 and height = top").groupBy("a", "b", "height").agg(F.min("id").alias("base")))
        if len(settled) % 8 == 0:
            settled = [stored(_union(settled), "bases")]
        rest = now.where("not met")
        down = rest.where("height = top").drop("height").join(edges, "id").select("a", "b", F.col("parent").alias("id"), "height", "marks")
        frontier = rest.where("height < top").select("a", "b", "id", "height", "marks").unionByName(down)
    return _union(settled) if settled else pairs.limit(0).select("a", "b", F.lit(0).cast("long").alias("height"), F.lit(None).cast(commits.schema["id"].dataType).alias("base"))
