"""Lifecycles of secrets while commits arrive, in any order.

A stream of sightings is kept as intervals of commits, per secret and bucket of order indexes, so that those of a secret that
every commit has are spread, and no row grows beyond a bucket. A batch adds the intervals of its own sightings; from time to time those of all
batches so far are united into one table. A commit that comes late closes gaps or opens intervals in the past; the result
is that of the same sightings in any other order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from keysweep.operators.history import lifecycle_of_intervals
from keysweep.operators.intervals import BUCKET, union_intervals

_ROWS = "secret_id binary, first array<bigint>, last array<bigint>"

# The intervals of this many batches are united, so what is read grows with intervals, not with batches.
UNITED_BATCHES = 64


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest intervals that hold the same numbers, in order."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate(([True], first[1:] > last[:-1] + 1))
    return first[begins], np.append(last[:-1][begins[1:]], last[-1])


def _runs(at: str) -> tuple[Column, Column]:
    """First and last numbers of the runs in an array of distinct numbers in order."""
    def ends(step: int, name: str) -> Column:
        # ``get`` gives null outside of the array.
        return F.filter(at, lambda n, i: F.coalesce(F.get(at, i + step) != n + step, F.lit(True))).alias(name)
    return ends(-1, "first"), ends(1, "last")


class LifecycleStream:
    """What is known of secrets from a stream of sightings, in the shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def start(self, sightings: DataFrame, **trigger) -> StreamingQuery:
        """Follow the stream ``(secret_id, order_index)``; repeated sightings change nothing, those with a null are left out.

        A batch that runs again after a failure writes its folder again, so each counts once. ``trigger`` is that of the stream writer.
        """
        keyed = sightings.where("secret_id IS NOT NULL AND order_index IS NOT NULL") \
            .select("secret_id", F.floor(F.col("order_index") / BUCKET).alias("bucket"), F.col("order_index").cast("long").alias("order_index"))
        def write(rows: DataFrame, batch: int) -> None:
            own = rows.groupBy("secret_id", "bucket").agg(F.sort_array(F.collect_set("order_index")).alias("at"))
            self._write(own.select("secret_id", *_runs("at")), f"batch={batch}")
            if (batch + 1) % UNITED_BATCHES == 0:
                # A run that breaks off leaves an unfinished folder, which is not read and written again.
                spans = self._united(batch).withColumn("bucket", F.floor(F.col("first_index") / BUCKET))
                ends = spans.groupBy("secret_id", "bucket").agg(F.sort_array(F.collect_list(F.struct("first_index", "last_index"))).alias("runs"))
                self._write(ends.select("secret_id", F.col("runs.first_index").alias("first"), F.col("runs.last_index").alias("last")), f"until={batch}")

        return keyed.writeStream.outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint") \
            .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/intervals/{folder}", compression="zstd")

    def _done(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to their end."""
        context = self.spark.sparkContext
        pattern = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/intervals/{kind}=*/_SUCCESS")
        files = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in files)

    def _united(self, last: int | None = None) -> DataFrame:
        """The intervals of all batches, or of those up to ``last``."""
        until = max((n for n in self._done("until") if last is None or n < last), default=-1)
        batches = [n for n in self._done("batch") if n > until and (last is None or n <= last)]
        folders = [f"until={until}"] * (until >= 0) + [f"batch={n}" for n in batches]
        rows = self.spark.createDataFrame([], _ROWS) if not folders else \
            self.spark.read.schema(_ROWS).parquet(*(f"{self.path}/intervals/{f}" for f in folders))
        spans = rows.select("secret_id", F.inline(F.arrays_zip("first", "last"))).withColumnsRenamed({"first": "first_index", "last": "last_index"})
        # A beginning occurs once in each folder at most.
        return union_intervals(spans, ["secret_id"], "first_index", "last_index", few=True)

    def intervals(self) -> DataFrame:
        """``(secret_id, first_index, last_index)`` as of the batches that are done."""
        return self._united()

    def lifecycle(self, found: DataFrame, commits: DataFrame) -> DataFrame:
        """One row per secret, as a scan of the whole history gives it."""
        return lifecycle_of_intervals(self.intervals(), found, commits)
