"""Equi-joins whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysweep.plans.store import stored

# A key is hot if it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1024
# Keys are counted in this many buckets first; only buckets with a hot key's share of the rows are counted key by key.
COUNT_BUCKETS = 8192
# Rows of a hot key go to this many places.
SALTS = 256
# A side whose measured size is at most this is sent to all executors.
BROADCAST_BYTES = 32 << 20


def _hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """``(key, _hot)`` of the keys with more than 1/HOT_SHARE of the rows, fewer than HOT_SHARE; nothing if there are none.

    What is shuffled does not grow with the number of keys: counts of buckets, then counts of the keys in full buckets.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(COUNT_BUCKETS))
    sizes = [(r["_b"], r["_n"]) for r in rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).collect()]
    total = sum(n for _, n in sizes)
    full = [b for b, n in sizes if n * HOT_SHARE > total]
    if not full:
        return None
    counts = rows.where(bucket.isin(full)).groupBy(key).agg(F.count("*").alias("_n"))
    hot = stored(counts.where(F.col("_n") * HOT_SHARE > total).select(key, F.lit(True).alias("_hot")))
    return None if hot.isEmpty() else F.broadcast(hot)


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
              weights: DataFrame | None = None, small_bytes: int | None = None) -> DataFrame:
    """Join where ``key`` repeats in ``big`` without bound and little in ``small``.

    If the size of ``small`` was measured and is low, it is broadcast. Otherwise rows of
    hot keys are dealt out over salts, and only the hot rows of ``small`` are copied
    once per salt; without hot keys it is a plain join. ``weights`` stands in for ``big`` when the keys are counted.
    ``how`` may be ``inner``, ``left`` or ``left_semi``.
    """
    if small_bytes is not None and small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, how)
    hot = _hot_keys(big if weights is None else weights, key)
    if hot is None:
        return big.join(small, key, how)
    others = [c for c in big.columns if c != key]
    # The salt is a function of the row, so a task that runs again deals its rows the same way.
    deal = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0)
    dealt = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), deal).otherwise(F.lit(0))) \
        .drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = small.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
