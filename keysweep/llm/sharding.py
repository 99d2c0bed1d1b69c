"""A reproducible shuffle into shards: a keyed permutation of global row numbers, with no sort by random keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from keysweep.plans.store import stored

ROUNDS = 4
#: Copies of a row that are numbered in one place.
BLOCK = 1 << 14


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function (multiply and shift)."""
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Place of each ``index`` (0 to ``n`` - 1) in a permutation of ``n`` numbers; ``back`` undoes it.

    A Feistel network permutes the smallest even number of bits that holds ``n``; what falls outside is sent
    through again until it is inside (cycle walking: the domain is below ``4 * n``, so four passes on average at most).
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [(key * 0x2545F4914F6CDD1D + r * 0xD1342543DE82EF95 + 1) % (1 << 64) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & low), left
            else:
                left, right = right, left ^ (_mix(right, k) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row``: gapless numbers from 0 in the order of all columns, nulls first.

    Equal rows are counted before they are sorted and come back as so many consecutive numbers, ``BLOCK`` at a time, so rows that occur very
    often neither meet in one range nor leave one task. Ranges of the order are numbered on their own; only one sum per range meets in one place.
    """
    order = rows.columns
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    counted = rows.groupBy(*order).agg(F.count("*").alias("_copies"))
    ranged = stored(counted.repartitionByRange(int(parts), *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_copies").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.sum("_copies").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # One row per range; their number is a setting, not a property of the data.
    placed = ranged.withColumn("_until", inside).join(F.broadcast(firsts), "_range") \
        .withColumn("_from", F.col("_first") + F.col("_until") - F.col("_copies"))

    def spread(some: DataFrame) -> DataFrame:
        return some.select(*order, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_copies") - 1)).alias("row"))

    last = F.col("_from") + F.col("_copies") - 1
    blocks = placed.where(F.col("_copies") > BLOCK).select(*order, last.alias("_last"), F.explode(F.sequence(F.col("_from"), last, F.lit(BLOCK))).alias("_from")) \
        .select(*order, "_from", F.least(F.lit(BLOCK), F.col("_last") - F.col("_from") + 1).alias("_copies")).repartition("_from")
    return spread(placed.where(F.col("_copies") <= BLOCK)).unionByName(spread(blocks))


def shards(docs: DataFrame, n_shards: int, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, size, crc, row, place, shard, slot``.

    ``row`` is the global number in the order of id, CRC and size (nulls first), ``place`` its place in the permutation;
    ``shard`` is ``place % n_shards`` and ``slot`` is ``place // n_shards``, so the row of any slot can be
    computed (``permute(..., back=True)``) and counts differ by one at most. The shuffle depends on the
    multiset of (id, text) and the key alone, not on partitions. ``size`` is the UTF-8 bytes of the text (null: none) plus 16.
    Repeated rows get places of their own. Only the two named columns are read, and only numbers are shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
                       (F.octet_length(text) + 16).cast("long").alias("size"))
    placed = stored(numbered(rows))
    n = placed.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, key))

    return placed.withColumn("place", place("row")).select(
        "*", (F.col("place") % n_shards).cast("int").alias("shard"), F.expr(f"place div {int(n_shards)}").alias("slot"))
