"""Commit order from parents alone: every commit behind all of its parents.

The generation of a commit is the number of commits on the longest way to it from a commit without parents. Commits in a line are jumped over
in doubling steps; what remains are merges and roots, whose generations follow from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keysweep.plans.skew import skew_join
from keysweep.plans.store import stored

#: Links between merges that one task may hold; more are solved level by level.
LOCAL_LINKS = 2_000_000


def _numbered(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commit, time, _id``, a row for each commit, and ``_id, parents`` for those with parents in the table, as numbers.

    Names move here and in the end; in between commits are numbers. Parents that are not in the table do not count, as in a shallow copy of a history.
    """
    kind = "array<string>"
    once = commits.where("commit IS NOT NULL").groupBy("commit").agg(
        F.flatten(F.collect_set(F.coalesce(F.col("parents"), F.array().cast(kind)))).alias("parents"), F.min("time").alias("time"))
    once = stored(once.withColumn("_id", F.monotonically_increasing_id()), "zstd")
    links = once.select("_id", F.explode("parents").alias("commit")).where("commit IS NOT NULL")
    links = skew_join(links, once.select("commit", F.col("_id").alias("_parent")), "commit")
    return once, stored(links.groupBy("_id").agg(F.collect_set("_parent").alias("parents")))


def _jumps(nodes: DataFrame) -> DataFrame:
    """``_id, anchor, steps`` of commits with one parent: the nearest merge or root that their line of commits leads back to."""
    at = stored(nodes.where("size(parents) = 1").select("_id", F.col("parents")[0].alias("anchor"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")))
    done, moving = at.where("done"), at.where("NOT done")
    for _ in range(max(1, at.count()).bit_length() + 2):
        if moving.isEmpty():
            return done.drop("done")
        further = done.unionByName(moving).select(
            F.col("_id").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        # Twice the way in each round; an anchor without a row is a merge or a root.
        at = stored(skew_join(moving.drop("done"), further, "anchor", how="left").select(
            "_id", F.coalesce("_anchor", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.coalesce("_done", F.lit(True)).alias("done")))
        done, moving = done.unionByName(at.where("done")), at.where("NOT done")
    raise ValueError("some commits are their own ancestors")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Generations of merges from rows ``_id, anchor, gain``; an anchor without rows of its own is a root."""
    into: dict[int, list[tuple[int, int]]] = {}
    waiting: dict[int, int] = {}
    found: dict[int, int] = {}
    for batch in batches:
        for commit, anchor, gain in zip(*(batch.column(c).to_pylist() for c in ("_id", "anchor", "gain"))):
            waiting[commit] = waiting.get(commit, 0) + 1
            into.setdefault(anchor, []).append((commit, gain))
    ready = [c for c in into if c not in waiting]
    best = dict.fromkeys(ready, 0)
    while ready:
        at = ready.pop()
        if at in waiting:
            found[at] = best[at]
        for commit, gain in into.get(at, ()):
            best[commit] = max(best.get(commit, 0), best[at] + gain)
            waiting[commit] -= 1
            if not waiting[commit]:
                ready.append(commit)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(found.values(), pa.int64())], names=["_id", "generation"])


def _merged(nodes: DataFrame, jumps: DataFrame, local_links: int) -> DataFrame:
    """``_id, generation`` of merges."""
    steps = jumps.select(F.col("_id").alias("parent"), "anchor", "steps")
    ways = skew_join(nodes.where("size(parents) > 1").select("_id", F.explode("parents").alias("parent")), steps, "parent", how="left")
    ways = ways.select("_id", F.coalesce("anchor", "parent").alias("anchor"), (F.coalesce("steps", F.lit(0)) + 1).alias("gain"))
    # The ways of a merge are as few as its parents, so they can lie in one place.
    ways = ways.repartition("_id").groupBy("_id", "anchor").agg(F.max("gain").alias("gain"))
    ways = stored(ways.withColumn("n", F.count("*").over(Window.partitionBy("_id"))))
    if ways.count() <= local_links:
        return stored(ways.select("_id", "anchor", "gain").coalesce(1).mapInArrow(_in_one_task, "_id long, generation long"))
    # Each way is gone once, when its beginning is known; a merge is known when all of its ways have been gone.
    begun = stored(ways.select("anchor").distinct().join(ways.select(F.col("_id").alias("anchor")), "anchor", "left_anti"))
    level = begun.select(F.col("anchor").alias("_id"), F.lit(0).cast("long").alias("generation"))
    waiting, found = None, []
    while n := level.count():
        gone = skew_join(ways, level.select(F.col("_id").alias("anchor"), "generation"), "anchor", small_bytes=32 * n)
        gone = gone.select("_id", "n", F.lit(1).cast("long").alias("gone"), (F.col("generation") + F.col("gain")).alias("generation"))
        reached = stored((gone if waiting is None else gone.unionByName(waiting)).groupBy("_id").agg(
            F.first("n").alias("n"), F.sum("gone").alias("gone"), F.max("generation").alias("generation")))
        found.append(reached._stored_at)
        level, waiting = reached.where("gone = n").select("_id", "generation"), reached.where("gone < n")
    if not found:  # no merge hangs on a root
        return level
    return ways.sparkSession.read.schema(reached.schema).parquet(*found).where("gone = n").select("_id", "generation")


def commit_topology(commits: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``commit, generation, order_index`` from ``(commit, parents, time)``: an order in which parents come first.

    Commits are ordered by generation, then time (null first), then name, and numbered from 0 without gaps, so 0 is a commit without parents.
    Repeated rows of a commit are one, with all their parents and the earliest time. Parents that the table lacks do not count. A
    commit that is its own ancestor is an error. An empty table gives no rows.

    Rounds grow with the logarithm of the longest line of commits. Merges and roots, usually few, are solved in one task if their links are at most
    ``local_links``, else level by level, a round for each level in which only the commits of the level move.
    """
    once, nodes = _numbered(commits)
    jumps = _jumps(nodes)
    merges = _merged(nodes, jumps, local_links)
    if merges.count() < nodes.where("size(parents) > 1").count():
        raise ValueError("some commits are their own ancestors")
    # What is neither a merge nor behind one hangs on a root, whose generation is 0.
    base = merges.select(F.col("_id").alias("anchor"), F.col("generation").alias("_base"))
    placed = skew_join(jumps, base, "anchor", how="left").select("_id", (F.coalesce("_base", F.lit(0)) + F.col("steps")).alias("generation"))
    keys = ["generation", "time", "commit"]
    rows = once.select("commit", "time", "_id").join(placed.unionByName(merges), "_id", "left") \
        .select(F.coalesce("generation", F.lit(0)).cast("long").alias("generation"), "time", "commit")
    ordered = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "zstd")
    # Ids of a partition are consecutive; what comes before a partition is a sum over partitions.
    part = F.shiftright("_at", 33)
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    return ordered.withColumn("_part", part).join(F.broadcast(sizes), "_part") \
        .select("commit", "generation", (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).alias("order_index"))
