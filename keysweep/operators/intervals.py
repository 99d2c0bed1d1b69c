"""Sets of whole numbers as intervals, per key.

Numbers lie in buckets of ``BUCKET``. What a task sorts is one bucket of one key, or one row for each bucket of a key, so the work of
no task grows with how often a key occurs. Rows with a null key or bound are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keysweep.plans.store import stored

BUCKET = 1 << 16


def _bucket(at: str) -> Column:
    return F.floor(F.col(at) / BUCKET)


def with_next(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """The stored ``rows``, whose ``at`` are distinct per key, with the next higher ``at`` of their key as ``name``; null for the last."""
    rows = rows.withColumn("_bucket", _bucket(at))
    firsts = rows.groupBy(*keys, "_bucket").agg(F.min(at).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    behind = firsts.select(*keys, "_bucket", F.lead("_first").over(over).alias("_behind"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at)
    return rows.withColumn(name, F.lead(at).over(inside)).join(behind, [*keys, "_bucket"]) \
        .withColumn(name, F.coalesce(name, "_behind")).drop("_bucket", "_behind")


def union_intervals(intervals: DataFrame, keys: list[str], first: str = "first_pos", last: str = "last_pos", few: bool = False) -> DataFrame:
    """``(*keys, first, last)``: the runs of numbers that the intervals of a key cover together, as few and as long as can be.

    Runs are made inside each bucket of beginnings, with a running maximum of ends. Then only the last run of a bucket can go on in later buckets, and
    only runs at the beginning of a bucket can belong to an earlier one; a row for each bucket of a key tells which do.
    ``few`` says that no beginning of a key occurs very often, so that intervals need not be combined before they move: they move once.
    """
    given = intervals.where(F.col(first) <= F.col(last))
    for key in keys:
        given = given.where(F.col(key).isNotNull())
    place = [*keys, "_bucket"]
    rows = given.select(*keys, F.col(first).cast("long").alias("_at"), F.col(last).cast("long").alias("_until")).withColumn("_bucket", _bucket("_at"))
    rows = (rows.repartition(*place) if few else rows).groupBy(*place, "_at").agg(F.max("_until").alias("_until"))
    inside = Window.partitionBy(*place).orderBy("_at")
    ended = F.max("_until").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_ended", ended).withColumn("_most", F.max("_until").over(Window.partitionBy(*place))) \
        .where("_ended IS NULL OR _at > _ended + 1")
    # A run ends where the intervals before the next beginning do. The last one of a bucket also has the bucket's first beginning.
    final = F.lead("_at").over(inside).isNull()
    runs = stored(begins.select(
        *place, "_at", F.coalesce(F.lead("_ended").over(inside), "_most").alias("_until"),
        F.when(final, F.min("_at").over(Window.partitionBy(*place))).alias("_first")), "zstd")
    lasts = runs.where("_first IS NOT NULL")
    over = Window.partitionBy(*keys).orderBy("_bucket")
    lasts = lasts.withColumn("_before", F.max("_until").over(over.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("_whole", F.max("_until").over(Window.partitionBy(*keys)))
    reached = stored(lasts.where("_first <= _before + 1").select(*place, "_before"))
    others = runs.where("_first IS NULL").select(*keys, "_bucket", "_at", "_until")
    if reached.isEmpty():
        return others.unionByName(lasts.select(*place, "_at", "_until")).select(*keys, F.col("_at").alias(first), F.col("_until").alias(last))
    absorbed = runs.join(reached, place).where("_at <= _before + 1").groupBy(*place).agg(F.max("_until").alias("_taken"))
    others = others.join(reached, place, "left").where("_before IS NULL OR _at > _before + 1")
    # What is covered without a gap before the first own run of a bucket belongs to the last run of an earlier one.
    heads = lasts.join(absorbed, place, "left").where("_before IS NULL OR _at > _before + 1") \
        .withColumn("_reach", F.greatest("_before", "_taken"))
    heads = heads.withColumn("_until", F.coalesce(F.lead("_reach").over(over), "_whole"))
    return others.select(*keys, "_at", "_until").unionByName(heads.select(*keys, "_at", "_until")) \
        .select(*keys, F.col("_at").alias(first), F.col("_until").alias(last))


def at_or_before(points: DataFrame, marks: DataFrame, at: str, carry: list[str]) -> DataFrame:
    """Distinct ``points`` (``at``) with the columns ``carry`` of the last of the stored ``marks`` (distinct ``at``) that is not behind them;
    null if all are."""
    value = F.struct(*carry)
    rows = marks.select(at, value.alias("_mark"), F.lit(False).alias("_point")) \
        .unionByName(points.select(at, F.lit(None).cast(marks.select(value.alias("v")).schema["v"].dataType).alias("_mark"), F.lit(True).alias("_point"))) \
        .withColumn("_bucket", _bucket(at))
    lasts = marks.withColumn("_bucket", _bucket(at)).groupBy("_bucket").agg(F.max_by(value, F.col(at)).alias("_last"))
    buckets = rows.select("_bucket").distinct().join(lasts, "_bucket", "left")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_seen", F.last("_mark", ignorenulls=True).over(inside)).join(F.broadcast(carried), "_bucket")  # a row for each bucket
    mark = F.coalesce("_seen", "_carried")
    return found.where("_point").select(at, *(mark[c].alias(c) for c in carry))
